"""Scores and checks of skill documents: markdown with a head of ``key: value`` lines between ``---`` lines."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Weights of the seven dimensions.
WEIGHTS = {"completeness": 0.2, "clarity": 0.15, "specificity": 0.2, "examples": 0.15, "format": 0.1, "safety": 0.1, "agent_readiness": 0.1}
SECTIONS = ("overview|purpose|what", "when to use|usage|trigger", "critical rules|rules", "example", "anti-pattern|avoid|don't", "reference|see also|related")
FILLER = ("basically", "simply", "just", "very", "really", "actually", "obviously")
GENERIC = ("various", "several", "etc", "some kind", "things", "stuff", "appropriate", "as needed", "best practices")
DANGEROUS = tuple(map(re.compile, (r"rm -rf? +/", r"git push .*--force", r"drop (table|database)", r"chmod 777", r"curl [^\n|]*\| *(ba)?sh", r"mkfs", r"dd if=")))
RISKY = tuple(map(re.compile, (r"\beval\(", r"\bexec\(", r"shell *= *true")))
SECRETS = tuple(map(re.compile, (r"akia[0-9a-z]{16}", r"gh[pousr]_[a-z0-9]{20,}", r"-----begin [a-z ]*private key", r"(api[_-]?key|password|secret) *[:=] *[\"'][^\"'\s]{8,}")))
INJECTIONS = tuple(map(re.compile, (r"ignore (all |any )?(previous|prior) instructions", r"you are now", r"reveal .{0,20}system prompt")))
WARNING = re.compile(r"never|avoid|warning|danger|do not|don't|unsafe")

RESULT = "id long, completeness double, clarity double, specificity double, examples double, format double, safety double, agent_readiness double, overall double, grade string"


def head_of(text: str) -> dict[str, str] | None:
    """The keys of a closed head, None without one."""
    m = re.match(r"---\n(.*?)\n---(?:\n|\Z)", text, re.S)
    return dict(re.findall(r"(?m)^(\w[\w-]*):[ ]*(.*)$", m[1])) if m else None


def score(text: str) -> dict[str, float]:
    lines, low = text.split("\n"), text.lower()
    heads = [x.lstrip("#").strip().lower() for x in lines if re.match(r"#{1,6} ", x)]
    out = {"completeness": sum(any(re.search(s, h) for h in heads) for s in SECTIONS) / len(SECTIONS)}

    long = sum(len(x) > 120 for x in lines) / len(lines)
    run = walls = 0
    for x in lines:
        prose = bool(x.strip()) and not re.match(r"\s*([-*#|>`]|\d+\.)", x)
        run = run + 1 if prose else 0
        walls += run > 5
    filler = sum(len(re.findall(rf"\b{w}\b", low)) for w in FILLER)
    listed = sum(bool(re.match(r"\s*([-*] |\|)", x)) for x in lines) / len(lines)
    clarity = 1 - min(0.3, 2 * long) - min(0.3, 0.1 * walls) - (min(0.2, 0.03 * filler) if filler > 3 else 0) + 0.15 * (listed > 0.1) + 0.1 * (listed > 0.2)
    out["clarity"] = min(1.0, max(0.0, clarity))

    paths, names = len(re.findall(r"`[^`\n]*/[^`\n]*`", text)), len(re.findall(r"`[A-Za-z_][\w.]*(?:\(\))?`", text))
    vague = sum(low.count(w) for w in GENERIC)
    share = (paths + names) / (paths + names + vague) if paths + names + vague else 0.3
    out["specificity"] = min(1.0, max(0.0, share - 0.15 * (vague > 5)))

    blocks = re.findall(r"```(\w*)\n(.*?)```", text, re.S)
    if not blocks:
        out["examples"] = 0.0
    else:
        tagged, real = sum(bool(t) for t, _ in blocks), sum(bool(re.search(r"[=({;]|\b(def|class|import|const|func)\b", b)) for _, b in blocks)
        out["examples"] = min(1.0, (0.3, 0.5, 0.6)[min(len(blocks), 3) - 1] + 0.2 * tagged / len(blocks) + 0.2 * real / len(blocks))

    head = head_of(text)
    h2, h3 = text.find("\n## "), text.find("\n### ")
    checks = [head is not None] + ([bool(head.get("name")), bool(head.get("description"))] if head is not None else [])
    checks += [h3 < 0 or 0 <= h2 < h3, text.count("```") % 2 == 0]
    out["format"] = sum(checks) / len(checks)

    bad = sum(not WARNING.search(low[max(0, m.start() - 200) : m.end() + 200]) for p in (*DANGEROUS, *RISKY) for m in p.finditer(low))
    bad += sum(bool(p.search(low)) for p in (*SECRETS, *INJECTIONS))
    out["safety"] = max(0.0, 1 - 0.15 * bad)

    ready = (head is not None, bool(head and head.get("description")), "trigger" in low or "when to use" in low, bool(blocks), len(lines) <= 400, "rules" in low)
    out["agent_readiness"] = sum(ready) / len(ready)
    return out


def skill_scores(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Seven dimensions, the weighted whole and its grade; an empty text has 0 everywhere."""

    def run(batches):
        for pdf in batches:
            out = []
            for i, text in zip(pdf["id"], pdf["t"], strict=True):
                s = score(text) if text else dict.fromkeys(WEIGHTS, 0.0)
                whole = sum(w * s[k] for k, w in WEIGHTS.items())
                out.append((i, *(round(s[k], 6) for k in WEIGHTS), round(whole, 6), next((g for g, x in (("A", 0.9), ("B", 0.8), ("C", 0.7), ("D", 0.6)) if whole >= x), "F")))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in RESULT.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).mapInPandas(run, RESULT)


def validate(docs: DataFrame, id_col: str, text_col: str, strict: bool = False) -> DataFrame:
    """(id, rule, level): missing head keys and sections, templater tags, raw HTML, more than 400 lines."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    closed = t.rlike(r"^---\n[\s\S]*?\n---(\n|$)")
    head = F.when(closed, F.regexp_extract(t, r"^---\n([\s\S]*?)\n---", 1)).otherwise("")
    rules = [(f"missing_{k}", "error", ~head.rlike(rf"(?m)^{k}:")) for k in ("name", "description", "version")]
    rules += [
        ("missing_critical_rules", "error", ~t.rlike(r"(?m)^## Critical Rules")),
        ("template_tag", "error", t.rlike(r"<%|\{\{")),
        ("raw_html", "error", t.rlike(r"</?(div|span|table|script|style|br|img)[ />]")),
        ("too_long", "warning", F.size(F.split(t, "\n")) > 400),
    ]
    if strict:
        rules.append(("missing_examples", "warning", ~t.rlike(r"(?m)^## Examples")))
    found = F.filter(F.array(*(F.when(c, F.struct(F.lit(n).alias("rule"), F.lit(level).alias("level"))) for n, level, c in rules)), lambda x: x.isNotNull())
    return docs.select(F.col(id_col).alias("id"), F.explode(found).alias("x")).select("id", "x.rule", "x.level")
