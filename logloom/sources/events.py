"""What record lines tell: events with content-free fingerprints, tool calls, and their results. All native expressions.

Equal content gives equal fingerprints; no text but the prompt's own is kept. Variants are turned to JSON with
sorted names, so that a fingerprint doesn't depend on how a record was written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions import shell

from .catalogue import timestamp
from .records import got, short

# Fields that name an event, names of tools by family, and patterns of commands and hashes.
ID_FIELDS = ("id", "call_id", "client_id", "event_id", "turn_id")
CALLS = ("function_call", "custom_tool_call", "tool_call")
OUTPUTS = ("function_call_output", "custom_tool_call_output")
LIFECYCLE = ("task_started", "task_complete", "turn_aborted")
SHELLS = ("exec_command", "shell", "shell_command", "command")
SCRIPTS = ("exec", "js", "javascript")
COLLABORATION = ("wait", "wait_agent", "write_stdin", "spawn_agent", "followup_task", "list_agents")
FILES = ("view_image", "read_mcp_resource")
VALIDATION = r"(?:^|[\s/])(pytest|ruff|mypy|tox|nox|unittest|cargo\s+test|go\s+test|npm\s+test)"
GIT = r"^\s*(?:git|gh)(?:\s|$)"
FULL_HASH = r"(?im)^([0-9a-f]{40}|[0-9a-f]{64})$"
SHORT_HASH = r"(?m)^\[[^\]]*\s([0-9a-f]{7,64})\]"
RUN_IN_SHELL = ("git_inspection", "git_mutation", "testing", "linting", "type_checking", "build_packaging", "filesystem_inspection", "text_search", "python_execution", "dependency_management", "scientific_computation", "process_status_monitoring")

# a JSON object in a script, its strings whole, nested a few levels
TEXT = r'"(?:[^"\\]|\\.)*+"'
OBJECT = r"\{" + f"(?:[^{{}}\"]|{TEXT})*+" + r"\}"
for _ in range(5):
    OBJECT = r"\{" + f"(?:[^{{}}\"]|{TEXT}|{OBJECT})*+" + r"\}"
NESTED = r"(?s)tools\.([A-Za-z0-9_]+)\s*\(\s*(" + OBJECT + ")?"


def part(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def kind(v: Column) -> Column:
    """OBJECT, ARRAY, STRING, BIGINT, BOOLEAN ...; null where there is nothing."""
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def digest(v: Column) -> Column:
    return F.sha2(F.coalesce(F.to_json(v), F.lit("null")), 256)


def opened(v: Column) -> Column:
    """An object, or the one that a text holds."""
    return F.when(kind(v) == "STRING", F.try_parse_json(v.try_cast("string"))).otherwise(v)


def texts(v: Column) -> Column:
    """A message's text: its own, else the text of its parts by lines; null where there is none."""
    parts = F.filter(F.transform(F.try_variant_get(v, "$.content", "array<variant>"), lambda x: F.when(kind(part(x, "$.text")) == "STRING", got(x, "$.text"))), lambda t: t.isNotNull())
    return F.when(kind(part(v, "$.message")) == "STRING", got(v, "$.message")).when(F.size(parts) > 0, F.array_join(parts, "\n"))


def attachments(v: Column) -> Column:
    """Kind and digest of what a message brings besides its text."""
    def listed(k: str) -> Column:
        return F.transform(F.coalesce(F.try_variant_get(v, f"$.{k}", "array<variant>"), F.array().cast("array<variant>")), lambda x: F.concat(F.lit(k + ":"), digest(x)))

    lists = [listed(k) for k in ("images", "local_images", "audio", "local_audio")]
    parts = F.filter(F.coalesce(F.try_variant_get(v, "$.content", "array<variant>"), F.array().cast("array<variant>")), lambda x: (kind(x) == "OBJECT") & ~F.coalesce(got(x, "$.type") == "input_text", F.lit(False)))
    return F.concat(*lists, F.transform(parts, lambda x: F.concat(F.coalesce(got(x, "$.type"), F.lit("attachment")), F.lit(":"), digest(x))))


def length(v: Column) -> Column:
    """Characters of a text, items of a list or an object."""
    k = kind(v)
    return F.when(k == "STRING", F.length(v.try_cast("string"))).when(k == "ARRAY", F.size(F.try_variant_get(v, "$", "array<variant>"))).when(k == "OBJECT", F.size(F.try_variant_get(v, "$", "map<string, variant>")))


def stable_id(v: Column) -> Column:
    """A digest of the fields that name the event; null where there are none."""
    known = [F.when(kind(part(v, f"$.{f}")).isin("STRING", "BIGINT"), F.concat(F.lit(f + "="), F.to_json(part(v, f"$.{f}")))) for f in ID_FIELDS]
    return F.when(F.coalesce(*known).isNotNull(), F.sha2(F.concat_ws("\u0000", *known), 256))


def call_id(v: Column) -> Column:
    return F.when(kind(part(v, "$.call_id")).isin("STRING", "BIGINT"), digest(part(v, "$.call_id")))


def tool(v: Column) -> Column:
    return short(F.coalesce(F.nullif(got(v, "$.name"), F.lit("")), got(v, "$.tool_name")))


def command_of(args: Column) -> Column:
    """The command of a call's arguments."""
    return F.coalesce(*[F.when(kind(part(args, f"$.{k}")) == "STRING", F.nullif(got(args, f"$.{k}"), F.lit(""))) for k in ("cmd", "command")])


def typed(rows: DataFrame, line: str = "line") -> DataFrame:
    """rows and v (the record), record_type, payload (its object), payload_type, occurred_at; lines that are no object go."""
    v = F.try_parse_json(F.col(line))
    rows = rows.withColumn("v", v).where(kind(F.col("v")) == "OBJECT")
    v = F.col("v")
    own = F.coalesce(F.when(kind(part(v, "$.payload")) == "OBJECT", part(v, "$.payload")), F.parse_json(F.lit("{}")))
    return rows.select(*rows.columns, short(F.coalesce(*[F.nullif(got(v, f"$.{k}"), F.lit("")) for k in ("type", "event", "kind")])).alias("record_type"), own.alias("payload"), short(got(v, "$.payload.type")).alias("payload_type"), timestamp(F.coalesce(got(v, "$.timestamp"), got(v, "$.ts"))).alias("occurred_at"))


def with_family(rows: DataFrame) -> DataFrame:
    """Typed rows with their event's family; a call's name and command are columns first, as each is asked for several times."""
    p = F.col("payload")
    rows = rows.withColumn("__name", F.when(F.col("payload_type").isin(*CALLS), tool(p)))
    rows = rows.withColumn("__raw", F.when(F.col("__name").isin(*SHELLS), F.coalesce(part(p, "$.arguments"), part(p, "$.input"))))
    rows = rows.withColumn("__args", opened(F.col("__raw"))).withColumn("__run", F.lower(command_of(F.col("__args"))))
    return rows.withColumn("family", family(p, F.col("record_type"), F.col("payload_type"), F.col("__name"), F.col("__run"))).drop("__name", "__raw", "__args", "__run")


def family(payload: Column, record_type: Column, payload_type: Column, name: Column, run: Column) -> Column:
    role = short(got(payload, "$.role"))
    called = (
        F.when(name.contains("patch") | name.isin("edit", "write_file"), "patch_edit")
        .when(name.isin(*SHELLS) & run.rlike(GIT), "git_command")
        .when(name.isin(*SHELLS) & run.rlike(VALIDATION), "validation_command")
        .when(name.isin(*SHELLS), "shell_command")
        .otherwise("tool_call")
    )
    both = F.concat_ws(" ", F.coalesce(record_type, F.lit("")), F.coalesce(payload_type, F.lit("")))
    return (
        F.when(payload_type == "user_message", "user_message")
        .when(payload_type == "message", F.when(role == "user", "user_message").when(role == "assistant", "assistant_message"))
        .when(payload_type == "agent_message", F.when(record_type == "event_msg", "assistant_message").otherwise("inter_agent_message"))
        .when(payload_type.isin(*CALLS), called)
        .when(payload_type.isin(*OUTPUTS), "tool_output")
        .when(payload_type == "patch_apply_end", "patch_result")
        .when(payload_type.isin(*LIFECYCLE), "task_lifecycle")
        .when(both.contains("error") | both.contains("failed"), "error")
    )


def extracted(rows: DataFrame) -> DataFrame:
    """Events of typed rows: the rows' own columns but v and payload, with family, fingerprint, stable_id, content_length and (of user messages) text."""
    p, kept = F.col("payload"), [c for c in rows.columns if c not in ("v", "payload", "line")]
    rows = with_family(rows).where("family IS NOT NULL").withColumn("__text", texts(p))
    f, said = F.col("family"), F.col("__text")
    args, output, last = F.coalesce(part(p, "$.arguments"), part(p, "$.input")), part(p, "$.output"), part(p, "$.last_agent_message")
    word = lambda path: F.coalesce(short(got(p, path)), F.lit(""))
    called = f.isin("tool_call", "shell_command", "validation_command", "git_command", "patch_edit")
    private = [F.when(part(p, f"$.{k}").isNotNull(), F.concat(F.lit(k + ":"), digest(part(p, f"$.{k}")))) for k in ("changes", "stdout", "stderr")]
    content = (
        F.when(f == "user_message", F.concat_ws("\u0000", F.coalesce(said, F.lit("")), said.isNull().cast("string"), F.array_join(attachments(p), "\u0001")))
        .when(f.isin("assistant_message", "inter_agent_message"), F.concat_ws("\u0000", F.coalesce(said, F.lit("")), said.isNull().cast("string")))
        .when(called, F.concat_ws("\u0000", F.coalesce(tool(p), F.lit("")), word("$.namespace"), digest(args)))
        .when(f == "tool_output", F.concat_ws("\u0000", "payload_type", digest(output)))
        .when(f == "patch_result", F.concat_ws("\u0000", "payload_type", word("$.status"), F.coalesce(F.to_json(part(p, "$.success")), F.lit("")), *private))
        .when(f == "task_lifecycle", F.concat_ws("\u0000", "payload_type", word("$.reason"), part(p, "$.error").isNotNull().cast("string"), digest(last)))
        .otherwise(F.concat_ws("\u0000", "payload_type", digest(p)))
    )
    sizes = F.when(f.isin("user_message", "assistant_message", "inter_agent_message"), F.length(said)).when(called, length(args)).when(f == "tool_output", length(output)).when(f == "task_lifecycle", length(last)).when(f == "error", length(p)).otherwise(sum(F.coalesce(length(part(p, f"$.{k}")), F.lit(0)) for k in ("changes", "stdout", "stderr")))
    return rows.select(*[c for c in kept if c != "family"], "family", F.sha2(F.concat_ws("\u0000", "family", content), 256).alias("fingerprint"), stable_id(p).alias("stable_id"), sizes.alias("content_length"), F.when(f == "user_message", said).alias("text"))


def calls(rows: DataFrame) -> DataFrame:
    """Tool calls of typed rows, those in scripts one by one: the rows' own columns, call_id, operation_ordinal, tool_name, command."""
    p, kept = F.col("payload"), [c for c in rows.columns if c not in ("v", "payload", "line")]
    rows = rows.where(F.col("payload_type").isin(*CALLS)).withColumn("__tool", tool(p)).withColumn("__raw", F.coalesce(part(p, "$.arguments"), part(p, "$.input")))
    # each step is a column, as the next asks for it several times
    name, raw, said, args, source = (F.col(c) for c in ("__tool", "__raw", "__said", "__args", "__source"))
    rows = rows.withColumn("__said", F.when(kind(raw) == "STRING", raw.try_cast("string"))).withColumn("__args", F.when(said.isNotNull(), F.try_parse_json(said)).otherwise(raw))
    code = F.when(name.isin("js", "javascript") & (kind(part(args, "$.code")) == "STRING"), got(args, "$.code"))
    rows = rows.withColumn("__source", F.when(name.isin(*SCRIPTS), F.coalesce(code, said)))
    inner = F.arrays_zip(F.regexp_extract_all(source, F.lit(NESTED), F.lit(1)).alias("name"), F.regexp_extract_all(source, F.lit(NESTED), F.lit(2)).alias("args"))
    read = F.transform(inner, lambda x: F.struct(x["name"].alias("name"), F.try_parse_json(x["args"]).alias("args")))
    rows = rows.withColumn("__nested", F.transform(read, lambda x: F.struct(x["name"].alias("name"), command_of(x["args"]).alias("command"))))
    alone = F.array(F.struct(F.coalesce(F.nullif(name, F.lit("")), F.lit("unknown")).alias("name"), command_of(args).alias("command")))
    found = rows.select(*kept, call_id(p).alias("call_id"), F.posexplode(F.when(F.size("__nested") > 0, F.col("__nested")).otherwise(alone)).alias("operation_ordinal", "o"))
    return found.select(*kept, "call_id", "operation_ordinal", F.substring(F.coalesce(F.nullif(short(F.col("o.name")), F.lit("")), F.lit("unknown")), 1, 128).alias("tool_name"), F.col("o.command").alias("command"))


def tool_family(name: Column, category: Column) -> Column:
    n = F.lower(name)
    return (
        F.when(category.isin(*RUN_IN_SHELL) | n.isin(*SHELLS), "shell")
        .when(category == "editing_patching", "patch")
        .when(category == "user_interaction", "user_interaction")
        .when(n.isin(*COLLABORATION), "collaboration")
        .when(n.isin(*FILES), "file")
        .when(n.startswith("web__") | n.startswith("mcp__"), "network")
        .when(n == "unknown", "unknown")
        .otherwise("other")
    )


def classed(found: DataFrame) -> DataFrame:
    """calls() with the safe command, its class, and the tool's family; a tool without a command is classed by its name."""
    safe = shell.redacted(F.col("command"))
    rows = found.select("*", F.when(F.col("command").isNotNull(), safe).alias("__safe")).drop("command")
    once = rows.where("__safe IS NOT NULL").select(F.col("__safe.text").alias("__safe_text")).distinct().withColumn("__head", shell.resolved(F.col("__safe_text")))
    name, args = F.col("__head.executable"), F.col("__head.args")
    kinds = once.select("__safe_text", F.col("__head.typed").alias("executable"), shell.category(name, args).alias("__category"), shell.test_scope(name, args).alias("__scope"), shell.is_commit(name, args).alias("__commit"))
    rows = rows.join(kinds, F.col("__safe.text") == F.col("__safe_text"), "left")
    category = F.coalesce("__category", shell.tool_category(F.col("tool_name")))
    return rows.select(*[c for c in found.columns if c != "command"], tool_family(F.col("tool_name"), category).alias("tool_family"), category.alias("command_category"), F.col("__safe.text").alias("text"), F.col("__safe.fingerprint").alias("fingerprint"), "executable", F.when(F.col("__commit"), "git_commit").alias("operation"), F.coalesce("__scope", F.lit("not_applicable")).alias("test_scope"), F.coalesce("__safe.redacted", F.lit(False)).alias("redacted"), F.coalesce("__safe.truncated", F.lit(False)).alias("truncated"))


def results(rows: DataFrame) -> DataFrame:
    """Results of typed rows: the rows' own columns, call_id, result_status, exit_code, duration_seconds, full and short commit hash."""
    p, kept = F.col("payload"), [c for c in rows.columns if c not in ("v", "payload", "line")]
    out = part(p, "$.output")
    listed = F.filter(F.transform(F.try_variant_get(out, "$", "array<variant>"), lambda x: F.try_parse_json(F.when(kind(part(x, "$.text")) == "STRING", got(x, "$.text")))), lambda x: kind(x) == "OBJECT")
    found = F.when(kind(opened(out)) == "OBJECT", opened(out)).when(kind(out) == "ARRAY", F.get(listed, 0))
    rows = rows.where(F.col("payload_type").isin(*OUTPUTS, "patch_apply_end")).withColumn("__o", found)
    o = F.col("__o")
    code = F.when(kind(part(o, "$.exit_code")) == "BIGINT", got(o, "$.exit_code", "bigint"))
    patch = F.col("payload_type") == "patch_apply_end"
    flag = lambda v, path: F.when(kind(part(v, path)) == "BOOLEAN", got(v, path, "boolean"))
    status = F.when(patch, F.when(flag(p, "$.success"), "success").when(~flag(p, "$.success"), "failure").otherwise("unknown")).when(code == 0, "success").when(code.isNotNull(), "failure").when(flag(o, "$.isError"), "failure").when(flag(o, "$.ok"), "success").otherwise("unknown")
    seconds = F.when(kind(part(o, "$.wall_time_seconds")).isin("BIGINT", "DOUBLE", "DECIMAL") & (got(o, "$.wall_time_seconds", "double") >= 0), got(o, "$.wall_time_seconds", "double"))
    said = F.when(kind(part(o, "$.output")) == "STRING", got(o, "$.output"))
    full = F.array_distinct(F.regexp_extract_all(said, F.lit(FULL_HASH), F.lit(1)))
    return rows.select(*kept, call_id(p).alias("call_id"), status.alias("result_status"), F.when(~patch, code).alias("exit_code"), F.when(~patch, seconds).alias("duration_seconds"), F.when(F.size(full) == 1, F.lower(F.get(full, 0))).alias("commit_hash"), F.nullif(F.lower(F.regexp_extract(said, SHORT_HASH, 1)), F.lit("")).alias("commit_short"))
