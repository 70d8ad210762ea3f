"""Command lines for the activity of the views, made from rules: what stands before a command, the command, its arguments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NONE = "not_applicable"
#: What may stand before a command without being it.
BEFORE = ("", "cd services/api && ", "LANG=C.UTF-8 ", "LANG=C.UTF-8 TZ=UTC ", "sudo -n -u builder ", "nohup ", "env -u DEBUG MODE=quick ", "time -p ", "export STAGE=dev; ", "cd docs && nohup ")
#: A program as typed, its arguments, category and test scope.
COMMANDS = (
    ("git", "log --oneline -20", "git_inspection", NONE),
    ("git", "diff HEAD~2 -- src/app", "git_inspection", NONE),
    ("git", "rebase origin/main", "git_mutation", NONE),
    ("git", "commit -am wording", "git_mutation", NONE),
    ("pytest", "", "testing", "full_suite"),
    ("pytest", "tests/unit/test_parser.py", "testing", "file"),
    ("pytest", "-k empty_input", "testing", "subset"),
    ("pytest", "tests/unit/test_parser.py::test_nested", "testing", "subset"),
    ("tox", "", "testing", "full_suite"),
    ("go", "test", "testing", "full_suite"),
    ("python3", "-m pytest", "testing", "full_suite"),
    ("python3", "tools/convert.py --fast", "python_execution", NONE),
    ("flake8", "src", "linting", NONE),
    ("pyright", "src/app", "type_checking", NONE),
    ("pnpm", "add zod", "dependency_management", NONE),
    ("pip", "install wheel", "dependency_management", NONE),
    ("ninja", "-C out", "build_packaging", NONE),
    ("cargo", "build --release", "build_packaging", NONE),
    ("ag", "needle lib | head -5", "text_search", NONE),
    ("tree", "-L 2 src", "filesystem_inspection", NONE),
    ("wc", "-l " + " ".join(f"data/part-{i:04d}.csv" for i in range(16)), "filesystem_inspection", NONE),
    ("lsof", "-i :8080", "process_status_monitoring", NONE),
    ("sleep", "30", "wait_poll", NONE),
    ("vasp_std", "-n 4", "scientific_computation", NONE),
    ("patch", "-p1 fix.diff", "editing_patching", NONE),
    ("terraform", "plan -out next.plan", "other", NONE),
)
#: With a secret, and as it is kept.
SECRET = (
    ("curl -H 'Authorization: Basic dXNlcjpwdw' api.example.org", "curl -H 'Authorization: Basic [REDACTED]' api.example.org", "curl", "other"),
    ("API_KEY=k-1234 ninja all", "API_KEY=[REDACTED] ninja all", "ninja", "build_packaging"),
    ("mysql --password hunter2 shop", "mysql --password [REDACTED] shop", "mysql", "other"),
    ("wget https://example.org/v1?user=me&access_token=t0p", "wget https://example.org/v1?user=me&access_token=[REDACTED]", "wget", "other"),
)
#: Whose command isn't known: loops, groups, what only looks a command up, a quote without its end, nothing but set-up.
UNKNOWN = ("while read f; do wc $f; done", "(cd lib && go test)", "command -v ninja", "env -S 'go test'", "echo 'open", "cd lib", "if true; then ls; fi")


def commits(name: str, args: str) -> bool:
    return name == "git" and args.startswith("commit")


def _lines() -> list[tuple[str, str, str | None, str, str, bool, bool]]:
    """A command, its safe text, the program as typed, its category, test scope, whether it held a secret, whether it makes a commit."""
    out: list[tuple[str, str, str | None, str, str, bool, bool]] = []
    for before in BEFORE:
        for name, args, kind, scope in COMMANDS:
            line = f"{before}{name} {args}".strip()
            out.append((line, line, name, kind, scope, False, commits(name, args)))
        for line, safe, name, kind in SECRET:
            out.append((before + line, before + safe, name, kind, NONE, True, False))
    # typed with more blanks, by a path, through a runner
    for name, args, kind, scope in COMMANDS:
        out.append((f"  {name}   {args} ", f"{name} {args}".strip(), name, kind, scope, False, commits(name, args)))
        out.append((f"/usr/local/bin/{name} {args}".strip(), f"/usr/local/bin/{name} {args}".strip(), name, kind, scope, False, commits(name, args)))
        out.append((f"uv run --frozen {name} {args}".strip(), f"uv run --frozen {name} {args}".strip(), "uv", kind, scope, False, commits(name, args)))
    return out + [(line, line, None, "unknown", NONE, False, False) for line in UNKNOWN]


LINES = _lines()


def commands(activity: DataFrame) -> DataFrame:
    """event_id, sid, occurred_at, command, result_status; one line picked by each event's id."""
    lines = activity.sparkSession.createDataFrame([(i, x[0]) for i, x in enumerate(LINES)], "at_ long, command string")
    return activity.withColumn("at_", F.col("event_id") % len(LINES)).join(F.broadcast(lines), "at_").select("event_id", "sid", "occurred_at", "command", "result_status")


def _quoted(x: object) -> str:
    return "NULL" if x is None else str(x) if isinstance(x, bool) else "'" + str(x).replace("'", "''") + "'"


#: Each event with what is expected of its command.
SQL = "SELECT event_id, sid, occurred_at, result_status, l.* EXCLUDE (at_) FROM fx_activity JOIN (VALUES " + ", ".join("(" + ", ".join([str(i), *map(_quoted, x[1:])]) + ")" for i, x in enumerate(LINES)) + f") l(at_, text, executable, command_category, test_scope, redacted, is_commit) ON at_ = event_id % {len(LINES)}"
