"""Prompt text: redaction, descriptive features, intent rules. All native expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

LIMIT = 100_000
MARKER = "\n[TRUNCATED]"

# Shapes of secrets in the order of redaction, and what stands for them.
REDACTIONS = (
    (r"(?s)-----BEGIN [^-\n]*PRIVATE KEY-----.*?-----END [^-\n]*PRIVATE KEY-----", "[REDACTED PRIVATE KEY]"),
    (r"(?i)\b(authorization\s*:\s*(?:bearer|basic)\s+)[^\s,;]+", "$1[REDACTED]"),
    (r"\b(?:sk-[A-Za-z0-9_-]{16,}|ghp_[A-Za-z0-9_-]{16,}|github_pat_[A-Za-z0-9_-]{16,}|xox[baprs]-[A-Za-z0-9_-]{16,}|AKIA[0-9A-Z]{16})\b", "[REDACTED TOKEN]"),
    (r"(?i)\b(api[_-]?key|access[_-]?token|token|secret|password)(\s*[:=]\s*)[^\s,;]{6,}", "$1$2[REDACTED]"),
)

# Patterns of the descriptive features.
FEATURES = {
    "heading": r"(?im)^\s*(?:#{1,6}\s+|(?:goal|requirements?|constraints?|validation|tests?|acceptance criteria|scope|non-goals?)\s*:|(?:目標|目标|要求|約束|约束|驗收標準|验收标准|測試|测试|範圍|范围|非目標|非目标)\s*[：:])",
    "acceptance": r"(?i)\bacceptance criteria\b|驗收標準|验收标准",
    "validation": r"(?i)\b(pytest|test(?:s|ing)?|validate|validation|verify|ruff|mypy)\b|測試|测试|驗證|验证|校驗|校验",
    "path": r"(?i)(?<![\w.])(?:\.{0,2}/|~/|/)[^\s'\"`<>]+|(?<![\w.])[\w.-]+\.(?:py|md|toml|json|jsonl|yaml|yml|sql|sh|tsx?|jsx?|cpp|c|h)\b",
    "commit": r"(?im)^\s*(?:[-*]\s*)?(?:please\s+)?(?:git\s+)?commit\b|\b(?:create|make|produce)\s+(?:\w+\s+){0,3}commits?\b|\bcommits?\s+(?:this|it|the|these|changes?)\b|(?:請|请)?提交(?:這些|这些|更改|修改|代碼|代码)",
    "commits": r"(?i)\b(?:two|three|multiple|separate|focused|atomic|a few)\s+commits?\b|\bcommits?\s+(?:separately|individually)\b|(?:兩個|两个|三個|三个|多個|多个|分開|分别|各自|幾個|几个).{0,8}提交",
    "non_goal": r"(?im)^\s*(?:[-*]\s*)?(?:do not|don't|never|non-goals?\s*:|不要|不得|切勿|非目標\s*[：:]|非目标\s*[：:])",
    "read_only": r"(?i)\bread[- ]only\b|\bdo not (?:write|modify|change|delete)\b|只讀|只读|不得(?:寫入|写入|修改|刪除|删除)|不要(?:寫入|写入|修改|刪除|删除)",
    "requirement": r"(?im)^\s*(?:[-*+]\s+|\d+[.)]\s+|(?:must|should|support|ensure|add|implement|create|do not|never)\b|(?:必須|必须|應|应|需要|支持|實現|实现|添加|不要|不得)\b)",
}

# Texts without any of these (in lower case) cannot match the pattern, and are not searched by it.
NEEDED = {
    "acceptance": ("acceptance criteria", "驗收標準", "验收标准"),
    "validation": ("pytest", "test", "validat", "verify", "ruff", "mypy", "測試", "测试", "驗證", "验证", "校驗", "校验"),
    "path": ("/", ".py", ".md", ".toml", ".json", ".yaml", ".yml", ".sql", ".sh", ".ts", ".js", ".cpp", ".c", ".h"),
    "commit": ("commit", "提交"),
    "commits": ("commit", "提交"),
    "non_goal": ("do not", "don't", "never", "non-goal", "不要", "不得", "切勿", "非目"),
    "read_only": ("read", "do not", "只讀", "只读", "不得", "不要"),
}

# Intent rules in their order, which breaks ties; (name, pattern).
ACTIONS = (
    ("code_review", r"(?i)\b(code review|review|audit)\b|審查|审查|評審|评审"),
    ("bug_fix", r"(?i)\b(fix|debug|bug|error|failure|failing|broken)\b|修復|修复|調試|调试|報錯|报错"),
    ("refactor", r"(?i)\b(refactor|restructure|cleanup)\b|重構|重构"),
    ("implementation", r"(?i)\b(implement|build|create|add|develop|scaffold)\b|實現|实现|添加|創建|创建|構建|构建"),
    ("repository_assessment", r"(?i)\b(repository|repo)\b.{0,30}\b(assess|inspect|status|health)\b|倉庫.{0,20}(檢查|检查|評估|评估)"),
    ("testing", r"(?i)\b(test|pytest|validation|validate)\b|測試|测试|驗證|验证"),
    ("documentation", r"(?i)\b(documentation|docs|readme|docstring|write up)\b|文檔|文档|說明"),
    ("ui_work", r"(?i)\b(ui|user interface|dashboard|layout|css|frontend)\b|界面|介面|儀表板|仪表板"),
    ("scientific_status_or_diagnosis", r"(?i)\b(orca|vasp|cp2k|multiwfn|ase)\b.{0,40}\b(status|diagnos|converg|calculation|job)\b|計算.{0,20}(狀態|诊断|診斷)"),
    ("research_or_exploration", r"(?i)\b(research|investigate|explore|literature|compare approaches)\b|研究|調研|调研|探索|文獻|文献"),
    ("git_or_release", r"(?i)\b(git|commit|release|tag|pull request|\bpr\b)\b|提交|發布|发布|版本"),
    ("planning", r"(?i)\b(plan|design|architecture|roadmap)\b|計劃|计划|設計|设计|架構|架构"),
    ("question_answering", r"(?i)^\s*(what|why|how|where|when|can you explain)\b|^\s*(什麼|什么|為什麼|为什么|如何|怎麼|怎么)"),
)
DOMAINS = (
    ("scientific_computing", r"(?i)\b(orca|vasp|cp2k|multiwfn|ase|quantum chemistry|dft|xps)\b|量子化學|量子化学|科學計算|科学计算"),
    ("ui", r"(?i)\b(ui|frontend|dashboard|css|swiftui|streamlit)\b|界面|介面|儀表板|仪表板"),
    ("git_release", r"(?i)\b(git|commit|release|tag|pull request)\b|提交|發布|发布"),
    ("documentation", r"(?i)\b(documentation|readme|manuscript|docs|docstring)\b|文檔|文档|論文|论文"),
    ("data_analysis", r"(?i)\b(data analysis|pandas|numpy|plot|statistics|notebook)\b|數據分析|数据分析|統計|统计"),
    ("developer_tooling", r"(?i)\b(cli|pytest|ruff|mypy|tooling|observability)\b|開發工具|开发工具"),
    ("software_engineering", r"(?i)\b(code|python|repository|api|database|test|bug|implementation)\b|代碼|代码|軟件|软件|程式|程序"),
)
# Labels of facets, and lines that ask for nothing.
FACETS = (("ORCA", r"(?i)\borca\b"), ("VASP", r"(?i)\bvasp\b"), ("CP2K", r"(?i)\bcp2k\b"), ("ASE", r"(?i)\base\b"), ("Multiwfn", r"(?i)\bmultiwfn\b"), ("XPS", r"(?i)\bxps\b"), ("workflow", r"(?i)\b(workflow|orchestration|pipeline)\b|工作流|流程"))
NEGATED = r"(?i)^\s*(?:[-*]\s*)?(?:do not|don't|never|non-goal\s*:|不要|不得|切勿)\b"


def unicode(p: str) -> str:
    """Word characters and boundaries of all scripts; line starts after \\n only."""
    return "(?Ud)" + p


def hits(text: Column, p: str) -> Column:
    return F.regexp_count(text, F.lit(unicode(p)))


def redacted(text: Column) -> Column:
    """struct<text, redactions, status, original_characters, stored_characters, text_sha256>; the digest is of the whole redacted text."""
    n, now = F.lit(0), text
    for p, by in REDACTIONS:
        n = n + hits(now, p)
        now = F.regexp_replace(now, unicode(p), by)
    long = F.length(now) > LIMIT
    stored = F.when(long, F.concat(F.substring(now, 1, LIMIT - len(MARKER)), F.lit(MARKER))).otherwise(now)
    status = F.when((n > 0) & long, "redacted_and_truncated").when(n > 0, "redacted").when(long, "truncated").otherwise("none")
    return F.struct(stored.alias("text"), n.alias("redactions"), status.alias("status"), F.length(text).alias("original_characters"), F.length(stored).alias("stored_characters"), F.sha2(now, 256).alias("text_sha256"))


def lines_without(text: Column, p: str) -> Column:
    return F.array_join(F.filter(F.split(text, "\n"), lambda line: ~line.rlike(unicode(p))), "\n")


def once(value: Column, then: object) -> Column:
    """then(value), with the value worked out once however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def features(text: Column) -> Column:
    """Struct of descriptive features; each text is cut into lines and searched once by each pattern."""
    def any_of(low: Column, k: str) -> Column:
        return reduce(lambda x, y: x | y, [F.contains(low, F.lit(w)) for w in NEEDED[k]])

    def cut(t: Column) -> Column:
        low = F.lower(t)
        return once(low, lambda x: F.struct(t.alias("t"), x.alias("low"), F.when(any_of(x, "non_goal"), lines_without(t, FEATURES["non_goal"])).otherwise(t).alias("p")))

    parts = once(F.regexp_replace(text, "\r\n?", "\n"), cut)

    def of(x: Column) -> Column:
        t, positive = x["t"], x["p"]
        has = lambda s, k: any_of(x["low"], k) & s.rlike(unicode(FEATURES[k]))
        counts = F.struct(has(positive, "commits").alias("many"), hits(t, FEATURES["requirement"]).alias("needs"))
        return once(counts, lambda n: F.struct(
            F.length(text).alias("characters"),
            F.when(t == "", 0).otherwise(F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit(""))) + 1).alias("lines"),
            hits(t, FEATURES["heading"]).alias("headings"),
            has(t, "acceptance").alias("has_acceptance_criteria"),
            has(positive, "validation").alias("requests_validation"),
            F.when(any_of(x["low"], "path"), hits(t, FEATURES["path"])).otherwise(0).alias("paths"),
            (has(positive, "commit") | n["many"]).alias("requests_commit"),
            n["many"].alias("requests_multiple_commits"),
            has(t, "non_goal").alias("has_non_goals"),
            has(t, "read_only").alias("has_read_only_constraint"),
            F.when((n["needs"] == 0) & (F.trim(t) != ""), 1).otherwise(n["needs"]).alias("requirements"),
        ))

    return once(parts, of)


def scores(text: Column, weight: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """array<int>: weight times the hits (three at most) of each rule."""
    return F.array(*[weight * F.least(hits(text, p), F.lit(3)) for _, p in rules])


def best(sums: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """The rule of the greatest sum, the first of equals; null where all are zero."""
    top = F.array_max(sums)
    return F.when(top > 0, F.element_at(F.array(*[F.lit(n) for n, _ in rules]), F.array_position(sums, top).cast("int")))
