"""Rule scans, scores and checks over texts and their lines."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import n_words, occurrences
from tessera.operators.blocks import dealt, sliced, values
from tessera.sources.shared import settle


def lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, line_number from 1, line)."""
    rows = docs.select(F.col(id_col).alias("id"), F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")).alias("pos", "line"))
    return rows.select("id", (F.col("pos") + 1).cast("long").alias("line_number"), "line")


#: (rule, category, severity, pattern): case-insensitive, safe for RE2 and Java alike. SEC-001 to SEC-047 are those of the
#: original; the named ones after them go beyond it, so a line may have one of each.
SECURITY_RULES = (
    ("SEC-001", "prompt_injection", "critical", r"ignore\s+(all\s+)?previous\s+instructions"),
    ("SEC-002", "prompt_injection", "critical", r"you\s+are\s+now\s+"),
    ("SEC-003", "prompt_injection", "critical", r"system\s*:\s*"),
    ("SEC-004", "prompt_injection", "critical", r"disregard\s+(all\s+)?(prior|previous|above)"),
    ("SEC-005", "prompt_injection", "critical", r"forget\s+(everything|all|your)\b.*?\b(instructions|rules|training)"),
    ("SEC-006", "prompt_injection", "critical", r"act\s+as\s+(if\s+)?(you\s+)?(are|were)\s+"),
    ("SEC-007", "prompt_injection", "critical", r"<\s*system\s*>"),
    ("SEC-008", "prompt_injection", "critical", r"\[inst\]|\[/inst\]|<<sys>>"),
    ("SEC-010", "secrets", "critical", r"(?:akia|abia|acca|asia)[0-9a-z]{16}"),
    ("SEC-011", "secrets", "critical", r"(?:ghp|gho|ghu|ghs|ghr)_[a-z0-9_]{36,}"),
    ("SEC-012", "secrets", "critical", r"sk-[a-z0-9]{20,}"),
    ("SEC-013", "secrets", "critical", r"(?:password|passwd|pwd)\s*[=:]\s*['\"][^'\"]{8,}"),
    ("SEC-014", "secrets", "critical", r"(?:api[_-]?key|apikey)\s*[=:]\s*['\"][^'\"]{8,}"),
    ("SEC-015", "secrets", "critical", r"(?:secret|token)\s*[=:]\s*['\"][^'\"]{8,}"),
    ("SEC-016", "secrets", "critical", r"bearer\s+[a-z0-9\-._~+/]+=*"),
    ("SEC-017", "secrets", "critical", r"-----begin\s+(rsa\s+)?private\s+key-----"),
    ("SEC-020", "pii", "medium", r"\b[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z|]{2,}\b"),
    ("SEC-021", "pii", "medium", r"\b\d{3}[-.]?\d{2}[-.]?\d{4}\b"),
    ("SEC-022", "pii", "medium", r"(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b"),
    ("SEC-030", "destructive", "high", r"rm\s+-rf\s+[/~]"),
    ("SEC-031", "destructive", "high", r"rm\s+-rf\s+\*"),
    ("SEC-032", "destructive", "high", r"drop\s+(table|database|schema)"),
    ("SEC-033", "destructive", "high", r"truncate\s+table"),
    ("SEC-034", "destructive", "high", r"git\s+push\s+--force\s+origin\s+main"),
    ("SEC-035", "destructive", "high", r"chmod\s+777"),
    ("SEC-036", "destructive", "high", r"sudo\s+rm"),
    ("SEC-037", "destructive", "high", r":\(\)\{\s*:\|:&\s*\};:"),
    ("SEC-038", "destructive", "high", r"mkfs\."),
    ("SEC-039", "destructive", "high", r">\s*/dev/sd[a-z]"),
    ("SEC-040", "unsafe_code", "medium", r"\beval\s*\("),
    ("SEC-041", "unsafe_code", "medium", r"\bexec\s*\("),
    ("SEC-042", "unsafe_code", "medium", r"os\.system\s*\("),
    ("SEC-043", "unsafe_code", "medium", r"subprocess\.call\s*\(.*shell\s*=\s*true"),
    ("SEC-044", "unsafe_code", "medium", r"__import__\s*\("),
    ("SEC-045", "unsafe_code", "medium", r"pickle\.loads?\s*\("),
    ("SEC-046", "unsafe_code", "medium", r"yaml\.load\s*\([^)]*\)"),
    ("SEC-047", "unsafe_code", "medium", r"innerhtml\s*="),
    ("ignore-instructions", "prompt_injection", "critical", r"ignore (all |any )?(previous|prior|above) instructions"),
    ("system-prompt", "prompt_injection", "critical", r"(reveal|show|print) (me )?(your|the) system prompt"),
    ("github-token", "secrets", "critical", r"gh[pousr]_[a-z0-9]{20,}"),
    ("private-key", "secrets", "critical", r"-----begin [a-z ]*private key-----"),
    ("generic-secret", "secrets", "critical", r"(api[_-]?key|secret|password|token)[\"']?[ ]*[:=][ ]*[\"']?[a-z0-9_\-]{8,}"),
    ("remove-root", "destructive", "high", r"rm -r +(/|~|\*)"),
    ("force-push", "destructive", "high", r"git push .*(--force|-f)( |$)"),
    ("card", "pii", "medium", r"(^|[^0-9])[0-9]{16}([^0-9]|$)"),
    ("shell-true", "unsafe_code", "medium", r"shell *= *true"),
)
WARNING_WORDS = "never|avoid|warning|danger|do not|don't|unsafe|anti-pattern"
ANTI_HEADINGS = "anti-pattern|avoid|pitfall|mistake|don't|bad practice"


def security_findings(docs: DataFrame, id_col: str, text_col: str, rules=SECURITY_RULES, allow: tuple[str, ...] = (), content_cut: int = 120) -> DataFrame:
    """(id, rule_id, category, severity, line_number, line_content): every rule that hits a line.

    A hit below a heading of anti-patterns (within 30 lines), or with a warning word in
    the 15 lines before it or on it, is ``low``, and ``info`` inside a code fence as well.
    Texts without any hit leave before they are cut into lines, lines without one before
    rules are told apart.
    """
    rules = [r for r in rules if r[0] not in allow]
    # A line that is hit is hit in the whole text as well.
    docs = docs.where(F.lower(text_col).rlike("(?m)" + "|".join(f"(?:{p})" for *_, p in rules)))
    rows = lines(docs, id_col, text_col)
    w = Window.partitionBy("id").orderBy("line_number")
    fence = F.trim("line").startswith("```")
    heading = F.when(F.col("line").rlike(r"^#{1,3} "), F.lower("line"))
    rows = rows.select(
        "*",
        F.sum(F.when(fence, 1).otherwise(0)).over(w).alias("fences"),
        F.sum(F.when(fence, 1).otherwise(0)).over(Window.partitionBy("id")).alias("all_fences"),
        F.last(heading, ignorenulls=True).over(w.rowsBetween(-29, 0)).alias("heading"),
        F.max(F.lower("line").rlike(WARNING_WORDS)).over(w.rowsBetween(-15, 0)).alias("warned"),
    )
    # An unclosed last fence makes no block.
    in_code = fence | ((F.col("fences") % 2 == 1) & ~((F.col("all_fences") % 2 == 1) & (F.col("fences") == F.col("all_fences"))))
    context = F.coalesce(F.col("heading").rlike(ANTI_HEADINGS), F.lit(False)) | F.col("warned")
    found = F.filter(F.array(*(F.when(F.lower("line").rlike(p), F.struct(F.lit(i).alias("rule_id"), F.lit(c).alias("category"), F.lit(s).alias("severity"))) for i, c, s, p in rules)), lambda x: x.isNotNull())
    rows = rows.where(F.lower("line").rlike("|".join(f"(?:{p})" for *_, p in rules)))
    rows = rows.select("id", "line_number", "line", context.alias("context"), in_code.alias("code"), F.explode(found).alias("r"))
    severity = F.when(F.col("context") & F.col("code"), "info").when(F.col("context"), "low").otherwise(F.col("r.severity"))
    return rows.select("id", "r.rule_id", "r.category", severity.alias("severity"), "line_number", F.substring(F.trim("line"), 1, content_cut).alias("line_content"))


def severity_summary(findings: DataFrame) -> DataFrame:
    count = lambda s: F.count_if(F.col("severity") == s).alias(s)
    return findings.groupBy("id").agg(*map(count, ("critical", "high", "medium", "low", "info")), F.count("*").alias("total")).withColumn("passed", (F.col("critical") == 0) & (F.col("high") == 0))


def doc_scores(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Structure, completeness, code and clarity of a text, the weighted whole and its grade."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    n = lambda p: occurrences(t, p)
    d = docs.select(
        F.col(id_col).alias("id"), t.alias("t"), n_words(t).alias("words"), n(r"(?m)^#").alias("heads"), n(r"(?m)^# ").alias("h1"), n(r"(?m)^## ").alias("h2"), n(r"(?m)^### ").alias("h3"),
        n(r"(?m)^.*\|.*\|.*\|").alias("rows"), n("```mermaid").alias("mermaid"), n(r"(?m)^ *[-*] ").alias("items"), n(r"\*\*[^*\n]+\*\*").alias("bold"), n("```").alias("fences"), n(r"```[a-z]").alias("tagged"),
        F.size(F.filter(F.split(t, "\n\n"), lambda p: F.trim(p) != "")).alias("paras"), n("\n\n").alias("blanks"),
        F.filter(F.split(t, "[.!?]"), lambda s: (F.trim(s) != "") & ~F.trim(s).startswith("#")).alias("sents"),
    )
    mean = F.aggregate("sents", F.lit(0).cast("long"), lambda s, x: s + n_words(x)) / F.nullif(F.size("sents"), F.lit(0))
    pick = lambda *pairs: _first([(c, v) for c, v in pairs])
    c = F.col
    structure = F.when(c("heads") == 0, 0.0).otherwise(pick((c("h1") > 0, 0.25)) + pick((c("h2") >= 2, 0.35), (c("h2") == 1, 0.15)) + pick((c("h3") > 0, 0.2)) + F.when(c("heads").between(3, 15), 0.2).otherwise(0.1))
    complete = pick((c("rows") > 0, 0.25)) + pick((c("mermaid") > 0, 0.2)) + pick((c("items") >= 3, 0.2), (c("items") > 0, 0.1)) + pick((c("bold") >= 2, 0.15)) + pick((c("words") >= 300, 0.2), (c("words") >= 100, 0.1))
    code = F.when(c("fences") == 0, 0.0).otherwise(0.3 + pick((c("tagged") > c("mermaid"), 0.4)) + pick((c("fences") >= 2, 0.3)))
    clear = pick((c("paras") >= 3, 0.3), (c("paras") == 2, 0.15)) + pick((mean <= 25, 0.3), (mean <= 40, 0.15)) + pick((c("words") >= 200, 0.2), (c("words") >= 50, 0.1)) + pick((c("blanks") >= 3, 0.2))
    scored = d.select("id", *(F.when(c("t") == "", 0.0).otherwise(F.round(F.least(x, F.lit(1.0)), 6)).alias(k) for k, x in (("structure", structure), ("completeness", complete), ("code", code), ("clarity", clear))))
    scored = scored.withColumn("overall", F.round(0.3 * c("structure") + 0.3 * c("completeness") + 0.15 * c("code") + 0.25 * c("clarity"), 6))
    return scored.withColumn("grade", F.when(c("overall") >= 0.85, "PASS").when(c("overall") >= 0.6, "WARN").otherwise("FAIL"))


def _first(pairs: list[tuple[Column, float]]) -> Column:
    out = F.lit(0.0)
    for condition, value in reversed(pairs):
        out = F.when(condition, value).otherwise(out)
    return out


def quality_gate(scores: DataFrame, threshold: float = 0.7) -> DataFrame:
    """One row: mean, counts per grade, and whether the least overall score reaches the threshold (no scores: yes)."""
    c = F.col("overall")
    return scores.agg(F.round(F.avg(c), 6).alias("mean_overall"), F.count_if(c >= 0.85).alias("passed"), F.count_if((c >= 0.6) & (c < 0.85)).alias("warned"), F.count_if(c < 0.6).alias("failed"), F.coalesce(F.min(c) >= threshold, F.lit(True)).alias("gate"))


def style_violations(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, rule, line_number, severity): missing H1, empty sections, walls of text, no structure."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("id"), t.alias("t"))
    whole = base.select("id", F.filter(F.array(
        F.when(~F.col("t").rlike(r"(?m)^# "), F.struct(F.lit("missing_h1").alias("rule"), F.lit("error").alias("severity"))),
        F.when((n_words(F.col("t")) > 50) & ~F.col("t").rlike(r"(?m)^ *[-*] |^\||```"), F.struct(F.lit("no_structure").alias("rule"), F.lit("info").alias("severity"))),
    ), lambda x: x.isNotNull()).alias("v")).select("id", F.explode("v").alias("v")).select("id", "v.rule", F.lit(1).cast("long").alias("line_number"), "v.severity")
    paras = base.select("id", F.posexplode(F.split("t", "\n\n")).alias("pos", "p")).where((n_words(F.col("p")) > 150) & ~F.trim("p").rlike(r"^(#|\||```)"))
    walls = paras.select("id", F.lit("long_paragraph").alias("rule"), (F.col("pos") + 1).cast("long").alias("line_number"), F.lit("warning").alias("severity"))
    w = Window.partitionBy("id").orderBy("line_number")
    rows = lines(docs, id_col, text_col)
    head = F.col("line").rlike(r"^#{1,6} ")
    body = (F.trim("line") != "") & ~head & ~F.trim("line").startswith("<!--")
    ahead = w.rowsBetween(1, 19)
    rows = rows.select("*", head.alias("head"), F.min(F.when(head, F.col("line_number"))).over(ahead).alias("next_head"), F.min(F.when(body, F.col("line_number"))).over(ahead).alias("next_body"), F.max("line_number").over(Window.partitionBy("id")).alias("last"))
    far = F.lit(1 << 40)
    empty = rows.where(F.col("head") & (F.col("line_number") < F.col("last")) & (F.coalesce("next_body", far) >= F.coalesce("next_head", far)) & (F.col("next_head").isNotNull() | F.col("next_body").isNull()))
    return whole.unionByName(walls).unionByName(empty.select("id", F.lit("empty_section").alias("rule"), "line_number", F.lit("warning").alias("severity")))


#: (topic, words): the first topic with a word in the text wins.
TOPICS = (
    ("auth", "auth|login|jwt|token|session|oauth|permission"),
    ("database", "db|database|model|schema|migration|query|repository"),
    ("api", "route|endpoint|controller|handler|middleware|api"),
    ("config", "config|env|setting|constant"),
    ("testing", "test|spec|mock|fixture|e2e"),
    ("ci-cd", "ci|deploy|docker|pipeline|workflow|github"),
    ("security", "security|encrypt|hash|vulnerability|sanitize"),
    ("utils", "util|helper|lib|common|shared"),
)


def topics(docs: DataFrame, id_col: str, text_col: str, rules=TOPICS) -> DataFrame:
    """(id, topic, related): the first topic that matches, and the other ones that do, in order."""
    text = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    hit = F.filter(F.array(*(F.when(text.rlike(p), F.lit(t)) for t, p in rules)), lambda x: x.isNotNull())
    docs = docs.select(F.col(id_col).alias("id"), hit.alias("hit"))
    return docs.select("id", F.coalesce(F.get("hit", 0), F.lit("general")).alias("topic"), F.array_join(F.slice("hit", 2, 5), ",").alias("related"))


MARKERS = "TODO|FIXME|HACK|NOTE|DECISION|WHY|REASON"


def decisions(docs: DataFrame, id_col: str, text_col: str, context: int = 1) -> DataFrame:
    """(id, line_number, marker, text, context): marked comments of five characters or more, with their neighbouring lines."""
    rows = lines(docs, id_col, text_col)
    w = Window.partitionBy("id").orderBy("line_number")
    rows = rows.withColumn("context", F.array_join(F.collect_list("line").over(w.rowsBetween(-context, context)), "\n"))
    marker = F.regexp_extract("line", rf"({MARKERS})[:(]", 1)
    text = F.trim(F.regexp_extract("line", rf"(?:{MARKERS})[:(]+(.*)$", 1))
    return rows.select("id", "line_number", marker.alias("marker"), text.alias("text"), "context").where((F.col("marker") != "") & (F.length("text") >= 5))


#: (fact type, programming language or ``*``, pattern): per line the first one that holds for its language and matches wins.
CODE_FACT_RULES = (
    ("endpoint", "Go", r'\.(Get|Post|Put|Delete|Patch)\s*\(\s*"(/[^"]*)"'),
    ("endpoint", "Go", r'\.Handle(?:Func)?\s*\(\s*"(/[^"]*)"'),
    ("endpoint", "Go", r'(?:http\.Handle|mux\.Handle)\s*\(\s*"(/[^"]*)"'),
    ("endpoint", "Go", r'\.Handle(?:Func)?\s*\(\s*"((?:GET|POST|PUT|DELETE|PATCH)\s+/[^"]*)"'),
    ("endpoint", "Go", r'e\.(GET|POST|PUT|DELETE|PATCH)\s*\(\s*"(/[^"]*)"'),
    ("endpoint", "Python", r"""@(?:app|router|api)\.(get|post|put|delete|patch)\s*\(\s*["\'](/[^"\']*)"""),
    ("endpoint", "Python", r"""@(?:app|router|api)\.route\s*\(\s*["\'](/[^"\']*)"""),
    ("endpoint", "Python", r"""path\s*\(\s*["\']([^"\']+)"""),
    ("endpoint", "TypeScript", r"""\.(get|post|put|delete|patch)\s*\(\s*["\'](/[^"\']*)"""),
    ("endpoint", "TypeScript", r"""server\.route\s*\(\s*["\'](/[^"\']*)"""),
    ("endpoint", "JavaScript", r"""\.(get|post|put|delete|patch)\s*\(\s*["\'](/[^"\']*)"""),
    ("endpoint", "Java", r"""@(Get|Post|Put|Delete|Patch)Mapping\s*\(\s*["\']?(/[^"\')\s]*)"""),
    ("endpoint", "Java", r"""@RequestMapping\s*\([^)]*value\s*=\s*["\']?(/[^"\')\s]*)"""),
    ("endpoint", "Rust", r'#\[(get|post|put|delete|patch)\s*\(\s*"(/[^"]*)"'),
    ("endpoint", "Rust", r'\.route\s*\(\s*"(/[^"]*)"'),
    ("port", "*", r"""(?:ListenAndServe|listen|EXPOSE)\s*[(]?\s*["\']?[:]?(\d{2,5})"""),
    ("port", "*", r"""(?:port|PORT)\s*[:=]{1,2}\s*["\']?(\d{2,5})"""),
    ("port", "*", r"""(?:defaultPort|DEFAULT_PORT)\s*[:=]{1,2}\s*["\']?(\d{2,5})"""),
    ("version", "*", r"""(?:version|VERSION|Version)\s*[:=]\s*["\']([^"\']+)"""),
    ("db_table", "*", r"""CREATE\s+TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?[`"\']?(\w+)"""),
    ("db_table", "Python", r"""__tablename__\s*=\s*["\'](\w+)"""),
    ("db_table", "Python", r"class\s+\w+.*\bModel\b"),
    ("db_table", "TypeScript", r"""@Entity\s*\(\s*["\'](\w+)"""),
    ("db_table", "TypeScript", r"model\s+(\w+)\s*\{"),
    ("cli_command", "Go", r'Use:\s*"(\w+)"'),
    ("cli_command", "Go", r'flag\.(?:String|Int|Bool)\w*\s*\(\s*"([^"]+)"'),
    ("cli_command", "Python", r"""@(?:click\.command|app\.command)\s*\(\s*["\']?(\w*)"""),
    ("cli_command", "Python", r"""add_parser\s*\(\s*["\'](\w+)"""),
    ("cli_command", "Python", r"""add_argument\s*\(\s*["\']--([^"\']+)"""),
    ("cli_command", "TypeScript", r"""\.command\s*\(\s*["\'](\w+)"""),
    ("env_var", "*", r"""os\.(?:Getenv|LookupEnv)\s*\(\s*["\']([A-Z][A-Z0-9_]+)"""),
    ("env_var", "*", r"""os\.environ(?:\.get)?\s*[\[(]\s*["\']([A-Z][A-Z0-9_]+)"""),
    ("env_var", "*", r"process\.env\.([A-Z][A-Z0-9_]+)"),
    ("env_var", "*", r"""os\.getenv\s*\(\s*["\']([A-Z][A-Z0-9_]+)"""),
    ("mcp_tool", "Go", r'mcp\.NewTool\s*\(\s*"([^"]+)"'),
    ("mcp_tool", "Go", r'server\.AddTool\s*\(\s*"([^"]+)"'),
    ("mcp_tool", "Go", r"tool\.NewTool\s*\("),
    ("mcp_tool", "Python", r"@mcp\.tool"),
    ("mcp_tool", "Python", r"server\.add_tool"),
    ("mcp_tool", "Python", r'Tool\s*\(\s*name\s*=\s*"([^"]+)"'),
    ("mcp_tool", "TypeScript", r'server\.tool\s*\(\s*"([^"]+)"'),
    ("mcp_tool", "TypeScript", r"new\s+McpTool\s*\("),
    ("fts_ddl", "*", r"(?i)CREATE\s+VIRTUAL\s+TABLE\s+(\w+\s+USING\s+fts\d?)"),
    ("struct_field", "Go", r"^\s+[A-Z]\w+\s+\S+"),
    ("go_version", "*", r"^go\s+1\.\d+"),
    ("dedup_mechanism", "*", r"normalized_hash"),
    ("dedup_mechanism", "*", r"content_hash"),
    ("dedup_mechanism", "*", r"dedup(?:licate)?"),
    ("dedup_mechanism", "Go", r"NormalizedHash"),
    ("dedup_mechanism", "Go", r"ContentHash"),
    ("dedup_mechanism", "Python", r"unique_together"),
    ("dedup_mechanism", "Python", r"unique\s*=\s*True"),
    ("ui_framework", "Go", r"bubbletea"),
    ("ui_framework", "Go", r"charmbracelet"),
    ("ui_framework", "Go", r"tview"),
    ("ui_framework", "Go", r"termui"),
    ("ui_framework", "Python", r"tkinter"),
    ("ui_framework", "Python", r"PyQt"),
    ("ui_framework", "Python", r"streamlit"),
    ("ui_framework", "Python", r"gradio"),
    ("ui_framework", "Python", r"\brich\b"),
    ("ui_framework", "TypeScript", r"\bink\b"),
    ("ui_framework", "TypeScript", r"blessed"),
    ("sync_format", "*", r"\.jsonl"),
    ("sync_format", "*", r"\.ndjson"),
    ("sync_format", "*", r"jsonlines"),
    ("sync_format", "*", r"json\s+lines"),
    ("sync_format", "Go", r"jsonl\.gz"),
    ("sync_format", "Go", r"gzip.*json"),
    ("sync_format", "Go", r"json.*gzip"),
    ("db_engine", "Go", r'"(modernc\.org/sqlite)"'),
    ("db_engine", "Go", r'"(github\.com/mattn/go-sqlite3)"'),
    ("db_engine", "Go", r'"(github\.com/lib/pq)"'),
    ("db_engine", "Go", r'"(github\.com/go-sql-driver/mysql)"'),
    ("db_engine", "Go", r'"(github\.com/jackc/pgx[^"]*)"'),
    ("db_engine", "Python", r"^import\s+(sqlite3)"),
    ("db_engine", "Python", r"^import\s+(psycopg2)"),
    ("db_engine", "Python", r"^from\s+(psycopg2)"),
    ("db_engine", "Python", r"^from\s+(sqlalchemy)"),
    ("db_engine", "Python", r"^import\s+(pymongo)"),
    ("db_engine", "Python", r"^from\s+(pymongo)"),
    ("db_engine", "TypeScript", r"""require\s*\(\s*['"](pg)['"]\)"""),
    ("db_engine", "TypeScript", r"""require\s*\(\s*['"](mysql2)['"]\)"""),
    ("db_engine", "TypeScript", r"""require\s*\(\s*['"](better-sqlite3)['"]\)"""),
    ("db_engine", "TypeScript", r"""from\s+['"]((?:@?prisma)[^'"]*)['"']"""),
    ("db_engine", "TypeScript", r"""from\s+['"](drizzle-orm)['"']"""),
    ("db_engine", "JavaScript", r"""require\s*\(\s*['"](pg)['"]\)"""),
    ("db_engine", "JavaScript", r"""require\s*\(\s*['"](mysql2)['"]\)"""),
    ("db_engine", "JavaScript", r"""require\s*\(\s*['"](better-sqlite3)['"]\)"""),
    ("db_engine", "JavaScript", r"""from\s+['"]((?:@?prisma)[^'"]*)['"']"""),
    ("db_engine", "JavaScript", r"""from\s+['"](drizzle-orm)['"']"""),
)
#: (fact type, order, pattern with one group): the rules of all languages, for texts of none, and three of our own after them.
FACT_RULES = (
    ("port", 1, r"(?:ListenAndServe|listen|EXPOSE)\s*[(]?\s*[\"\x27]?[:]?(\d{2,5})"),
    ("port", 2, r"(?:port|PORT)\s*[:=]{1,2}\s*[\"\x27]?(\d{2,5})"),
    ("port", 3, r"(?:defaultPort|DEFAULT_PORT)\s*[:=]{1,2}\s*[\"\x27]?(\d{2,5})"),
    ("version", 4, r"(?:version|VERSION|Version)\s*[:=]\s*[\"\x27]\s*([^\"\x27\s](?:[^\"\x27]*[^\"\x27\s])?)"),
    ("db_table", 5, r"CREATE\s+TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?[`\"\x27]?(\w+)"),
    ("env_var", 6, r"os\.(?:Getenv|LookupEnv)\s*\(\s*[\"\x27]([A-Z][A-Z0-9_]+)"),
    ("env_var", 7, r"os\.environ(?:\.get)?\s*[\[(]\s*[\"\x27]([A-Z][A-Z0-9_]+)"),
    ("env_var", 8, r"process\.env\.([A-Z][A-Z0-9_]+)"),
    ("env_var", 9, r"os\.getenv\s*\(\s*[\"\x27]([A-Z][A-Z0-9_]+)"),
    ("fts_ddl", 10, r"(?i)CREATE\s+VIRTUAL\s+TABLE\s+(\w+\s+USING\s+fts\d?)"),
    ("go_version", 11, r"^(go\s+1\.\d+(?:.*\S)?)"),
    ("dedup_mechanism", 12, r"^\s*((?:\S.*)?(?:normalized_hash|content_hash|dedup)(?:.*\S)?)"),
    ("sync_format", 13, r"^\s*((?:\S.*)?(?:\.jsonl|\.ndjson|jsonlines|json\s+lines)(?:.*\S)?)"),
    ("phone", 14, r"(\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4})"),
    ("email", 15, r"([a-z0-9._]+@[a-z0-9.]+)"),
    ("number", 16, r"([0-9]{4,})"),
)


def _fact_value(pattern: str) -> Column:
    """The method in capitals and the path of two groups, one group, or the whole line, without outer space."""
    bare = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    groups = re.compile(pattern).groups
    if groups > 1:
        return F.concat(F.upper(F.regexp_extract("line", pattern, 1)), F.lit(" "), bare(F.regexp_extract("line", pattern, 2)))
    return bare(F.regexp_extract("line", pattern, 1) if groups else F.col("line"))


def facts(docs: DataFrame, id_col: str, text_col: str, rules=FACT_RULES, language_col: str | None = None) -> DataFrame:
    """(fact_type, value, first_id, first_line): per line the first rule that matches, distinct values at their first place.

    With ``language_col``, the programming language of each text, the ``CODE_FACT_RULES`` of all languages and of its own hold instead of ``rules``.
    """
    if language_col is None:
        rows = lines(docs, id_col, text_col)
        tests = [(k, p, F.lit(True)) for k, _, p in sorted(rules, key=lambda r: r[1])]
    else:
        rows = lines(docs.select(F.struct(F.col(id_col).alias("id"), F.col(language_col).alias("language")).alias("id"), F.col(text_col).alias("t")), "id", "t")
        rows = rows.select(F.col("id.id").alias("id"), F.col("id.language").alias("language"), "line_number", "line")
        tests = [(k, p, F.lit(True) if of == "*" else F.col("language") == of) for k, of, p in CODE_FACT_RULES]
    one = F.coalesce(*(F.when(holds & F.col("line").rlike(p), F.struct(F.lit(k).alias("fact_type"), _fact_value(p).alias("value"))) for k, p, holds in tests))
    rows = rows.select("id", "line_number", one.alias("f")).where("f is not null")
    return rows.groupBy("f.fact_type", "f.value").agg(F.min(F.struct("id", "line_number")).alias("x")).select("fact_type", "value", F.col("x.id").alias("first_id"), F.col("x.line_number").alias("first_line"))


def headings(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(id, ord, level, heading) of h1 to h6."""
    rows = pages.select(F.col(id_col).alias("id"), F.posexplode(F.regexp_extract_all(F.col(html_col), F.lit(r"(<h[1-6][^>]*>[^<]*</h[1-6]>)"), 1)).alias("pos", "h"))
    return rows.select("id", (F.col("pos") + 1).cast("long").alias("ord"), F.regexp_extract("h", "^<h([1-6])", 1).cast("long").alias("level"), F.trim(F.regexp_replace("h", "<[^>]*>", "")).alias("heading"))


def strip_html(html: Column) -> Column:
    """Markdown-like text: code, headings, items and paragraphs, other tags dropped, six entities decoded; script and style bodies stay."""
    x = F.coalesce(html, F.lit(""))
    for pattern, to in ((r"<pre[^>]*>", "\n```\n"), (r"</pre>", "\n```\n"), (r"</?code[^>]*>", "`"), (r"<h1[^>]*>", "\n# "), (r"<h2[^>]*>", "\n## "), (r"<h3[^>]*>", "\n### "), (r"<h[4-6][^>]*>", "\n#### "), (r"<li[^>]*>", "\n- "), (r"<p[^>]*>", "\n\n"), (r"<[^>]+>", "")):
        x = F.regexp_replace(x, pattern, to)
    for entity, to in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        x = F.replace(x, F.lit(entity), F.lit(to))
    return F.trim(F.regexp_replace(x, "\n{3,}", "\n\n"))


NEGATIVE = "(^| )(never|not|avoid|don't|no)( |$)"


#: Rules in a block, and pairs of equal words of two blocks that are counted at once.
RULES, EQUAL = 4096, 1_000_000


def _word_blocks(docs: DataFrame) -> DataFrame:
    """(ids, doc, word): documents (id, words) in blocks; every word's number with the place of its document in the block, by document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, RULES):
            words = b.column(1)
            doc = np.repeat(np.arange(b.num_rows), words.value_lengths().to_numpy(zero_copy_only=False))
            word = words.flatten().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays([0, b.num_rows], b.column(0)), pa.array([doc.tobytes()], pa.binary()), pa.array([word.tobytes()], pa.binary())], ["ids", "doc", "word"])

    return settle(dealt(docs, docs.count(), 2 * RULES).mapInArrow(run, f"ids array<{dict(docs.dtypes)['id']}>, doc binary, word binary"), "rules")


def rule_conflicts(rules: DataFrame, id_col: str, text_col: str, subject_length: int = 9) -> DataFrame:
    """(a, b): rules of opposite polarity that share a subject word, and how many they share.

    The result grows with the square of the rules; what is shuffled does not: whole rules meet in blocks, their words as numbers, and a pair is
    counted where its blocks meet.
    """
    from tessera.functions.text import tokens

    text = F.lower(F.col(text_col))
    words = F.array_distinct(F.filter(tokens(F.col(text_col)), lambda w: F.length(w) >= subject_length))
    # The polarity is found per rule, before its words become rows.
    rows = rules.select(F.col(id_col).alias("id"), text.rlike(NEGATIVE).alias("neg"), words.alias("words"))
    rows = settle(rows.select("id", "neg", F.explode("words").alias("w")), "subjects")
    both = rows.groupBy("w").agg(F.bool_or("neg").alias("n"), F.bool_and("neg").alias("all")).where("n and not all")
    both = settle(both.select("w", F.monotonically_increasing_id().alias("no")), "words")
    docs = settle(rows.join(both, "w").groupBy("id", "neg").agg(F.collect_list("no").alias("words")), "numbered")
    a, b = (_word_blocks(docs.where(side).select("id", "words")) for side in ("not neg", "neg"))
    kind = dict(docs.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                doc, word, b_doc, b_word = (np.frombuffer(batch.column(c)[i].as_buffer(), np.int64) for c in (1, 2, 4, 5))
                at = np.argsort(b_word, kind="stable")
                b_doc, b_word = b_doc[at], b_word[at]
                first = np.searchsorted(b_word, word, "left")
                n = np.searchsorted(b_word, word, "right") - first
                a_ids, b_ids = values(batch.column(0), i), values(batch.column(3), i)
                # A document's words differ, so that all it meets are no more than the words of the other block.
                part = np.cumsum(np.bincount(doc, n, len(a_ids))).astype(np.int64)[doc] // EQUAL
                for lo, hi in zip(*(np.searchsorted(part, np.unique(part), side) for side in ("left", "right")), strict=True):
                    k = n[lo:hi]
                    other = np.repeat(first[lo:hi] - np.cumsum(k) + k, k) + np.arange(k.sum())
                    pair, shared = np.unique(np.repeat(doc[lo:hi], k) * len(b_ids) + b_doc[other], return_counts=True)
                    found = [a_ids.take(pa.array(pair // len(b_ids))), b_ids.take(pa.array(pair % len(b_ids))), pa.array(shared, pa.int64())]
                    yield pa.RecordBatch.from_arrays(found, ["a", "b", "shared"])

    pairs = a.crossJoin(b.select(*(F.col(c).alias(f"b_{c}") for c in b.columns)))
    return pairs.mapInArrow(run, f"a {kind}, b {kind}, shared long")
