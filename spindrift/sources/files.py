"""Directories, logs and settings as DataFrames."""

from __future__ import annotations

import hashlib
import json
import os
import re
import subprocess

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spindrift.functions import text as X
from spindrift.sources import fs

# Folders that are never read.
SKIPPED = ("node_modules", "dist", "build", "out", "coverage", "vendor", "target", "__pycache__")
MOST_BYTES = 1 << 20
KEY_FILE = re.compile(X.KEY_FILES)


class Ignore:
    """The patterns of one ignore file, applied to paths relative to its folder; of those that match the last decides."""

    def __init__(self, text: str):
        lines = [line.strip() for line in text.split("\n")]
        self.rules = [(not x.startswith("!"), x.endswith("/"), re.compile(glob(x.removeprefix("!")), re.S)) for x in lines if x and not x.startswith("#")]

    def verdict(self, path: str) -> bool | None:
        """True: ignored, False: taken back, None: no pattern matches.  A folder's path ends with a slash."""
        return next((ignored for ignored, folders, pattern in reversed(self.rules) if pattern.search(path if folders else path.rstrip("/"))), None)


def _walk(spark: SparkSession, root: str, ignored: list[str], policy: list[str]):
    """(path, bytes or None for a folder not entered, reason) of what lies below a folder, folder by folder."""
    if not fs.exists(spark, root):
        raise FileNotFoundError(root)
    system, base = fs._at(spark, root)
    own, pinned = Ignore("\n".join(ignored)), Ignore("\n".join(policy))
    if fs.exists(spark, f"{root}/.contextignore"):
        own.rules += Ignore(fs.read_text(spark, f"{root}/.contextignore")).rules
    git: dict[str, Ignore] = {}

    def enter(folder: str) -> None:
        texts = [fs.read_text(spark, f"{root}/{folder}{name}") for name in (".gitignore", *([".git/info/exclude"] if not folder else [])) if fs.exists(spark, f"{root}/{folder}{name}")]
        git[folder] = Ignore("\n".join(texts))

    def by_git(path: str) -> bool:
        """Every folder's file from the root down, the deeper one overriding."""
        parts, told = path.rstrip("/").split("/"), False
        for n in range(len(parts)):
            folder = "".join(f"{x}/" for x in parts[:n])
            verdict = git[folder].verdict(path[len(folder) :])
            told = told if verdict is None else verdict
        return told

    def reason(path: str) -> str | None:
        for name, rules in (("policy", pinned), ("contextignore", own)):
            if rules.verdict(path):
                return name
        if not path.endswith("/") and (KEY_FILE.search(path.rpartition("/")[2]) or any(x.lower() in X.KEY_FOLDERS for x in path.split("/")[:-1])):
            return "credential"
        return "ignored" if by_git(path) else None

    stack = [""]
    while stack:
        folder = stack.pop()
        enter(folder)
        at = spark._jvm.org.apache.hadoop.fs.Path(base, folder.rstrip("/")) if folder else base
        for entry in sorted(system.listStatus(at), key=lambda x: x.getPath().getName()):
            name = entry.getPath().getName()
            if entry.isDirectory():
                path = f"{folder}{name}/"
                why = "folder" if name in SKIPPED or name.startswith(".") and name != ".github" else reason(path)
                if why is None:
                    stack.append(path)
                else:
                    yield path, None, why
            else:
                path = folder + name
                yield path, int(entry.getLen()), reason(path) or ("size" if entry.getLen() > MOST_BYTES else None)


def scan(spark: SparkSession, root: str, ignored: list[str] | None = None, policy: list[str] | None = None) -> DataFrame:
    """path, bytes, reason (null: kept) of all files below a folder, and of the folders that are not entered (a slash behind their path, bytes null).

    The first rule that applies names the reason: skipped folder; policy; contextignore (given patterns, and the root's .contextignore);
    credential; ignored by .gitignore files, of which a deeper one overrides and a negation takes back; size.  The listing runs on the
    driver, as Spark's own does, over the folders that are entered; names that begin with a dot or an underscore are listed too.
    """
    return spark.createDataFrame([*_walk(spark, root.rstrip("/"), ignored or [], policy or [])], "path string, bytes long, reason string")


#: Files read by the driver at a time, since Spark's readers pass over names that begin with a dot or an underscore.
HIDDEN_BLOCK = 500


def glob(pattern: str) -> str:
    """An ignore pattern as a regular expression on relative paths: with a slash inside anchored, else at any depth."""
    bare = pattern.strip("/")
    known = {"**/": "(.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    body = "".join(known.get(part, re.escape(part)) for part in re.split(r"(\*\*/|\*\*|\*|\?)", bare))
    start = "^" if "/" in pattern.rstrip("/") else "(^|/)"
    return f"{start}{body}(/.*)" + ("" if pattern.endswith("/") else "?") + "$"


def read(spark: SparkSession, root: str, ignored: list[str] | None = None, policy: list[str] | None = None) -> DataFrame:
    """path, contents, hash, language of the kept text files."""
    base = root.rstrip("/")
    kept = [path for path, _, reason in _walk(spark, base, ignored or [], policy or []) if reason is None]
    hidden = [p for p in kept if p.rpartition("/")[2].startswith((".", "_"))]
    plain = [p for p in kept if not p.rpartition("/")[2].startswith((".", "_"))]
    schema = "path string, content binary"
    found = spark.createDataFrame([], schema)
    if plain:
        tail = base.split(":", 1)[-1].lstrip("/")
        found = spark.read.format("binaryFile").load([f"{base}/{p}" for p in plain]).select(F.regexp_replace("path", f"^.*?{re.escape(tail)}/", "").alias("path"), "content")
    for n in range(0, len(hidden), HIDDEN_BLOCK):
        found = found.unionAll(spark.createDataFrame([(p, bytearray(fs.read_text(spark, f"{base}/{p}", errors="surrogateescape").encode(errors="surrogateescape"))) for p in hidden[n : n + HIDDEN_BLOCK]], schema))
    contents = F.decode("content", "UTF-8")
    texts = found.where(~X.is_binary(F.col("content")))
    return texts.select("path", contents.alias("contents"), F.sha2(F.concat(F.col("path"), contents), 256).alias("hash"), X.language_of(F.col("path")).alias("language"))


def statistics(scanned: DataFrame, examples: int = 8) -> DataFrame:
    """reason ("kept" where none), files, examples (the first by name)."""
    named = scanned.withColumn("reason", F.coalesce("reason", F.lit("kept")))
    nth = F.row_number().over(Window.partitionBy("reason").orderBy("path"))
    shown = named.withColumn("nth", nth).where(F.col("nth") <= examples).groupBy("reason").agg(F.sort_array(F.collect_set("path")).alias("examples"))
    return named.groupBy("reason").agg(F.count(F.lit(1)).alias("files")).join(shown, "reason")


def audit_log(spark: SparkSession, path: str, kind: str | None = None, since: str | None = None, until: str | None = None, last: int | None = None) -> DataFrame:
    """seq, ts, type, data, prev, hash of a log of JSON lines; torn lines are left out."""
    rows = spark.read.text(path).select(F.from_json("value", "seq long, ts string, type string, data string, prev string, hash string").alias("r")).where("r.seq is not null").select("r.*")
    for wanted, condition in ((kind, F.col("type") == kind), (since, F.col("ts") >= F.lit(since)), (until, F.col("ts") <= F.lit(until))):
        rows = rows.where(condition) if wanted is not None else rows
    return rows if last is None else rows.orderBy(F.desc("seq")).limit(last).orderBy("seq")


# Where guidelines and project instructions are sought, in this order, and how much of the latter is read.
GUIDELINES = (".context-guidelines", ".oce-guidelines", ".context-guidelines.md", ".github/context-guidelines.md")
INSTRUCTIONS = ("AGENTS.md", "CLAUDE.md", ".cursorrules")
MOST_INSTRUCTIONS = 8000


def sections(spark: SparkSession, path: str) -> DataFrame:
    """file, place, title, scope, content of guidelines files, each split at its headings; scope from "[scope: a, b]" in the title, or a language that it names."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\n")).alias("pos", "line"))
    heading = F.col("line").rlike("^#{1,3}\\s+")
    numbered = files.withColumn("place", F.sum(heading.cast("int")).over(Window.partitionBy("file").orderBy("pos")))
    title = F.max(F.when(heading, F.trim(F.regexp_replace("line", "^#{1,3}\\s+", "")))).alias("title")
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(~heading, F.struct("pos", "line")))), lambda x: x["line"]), "\n").alias("content")
    scope = F.filter(F.transform(F.split(F.regexp_extract("title", r"\[scope:\s*([^\]]+)\]", 1), ","), lambda x: F.trim(x)), lambda s: s != "")
    table = F.create_map(*[F.lit(x) for language, endings in X.LANGUAGES.items() for x in (language, " ".join(f"*.{e}" for e in endings.split()))])
    by_name = F.try_element_at(table, F.lower(F.regexp_extract("title", r"^(\w+)", 1)))
    told = F.when(F.size(scope) > 0, scope).when(by_name.isNotNull(), F.split(by_name, " ")).otherwise(F.array().cast("array<string>"))
    return numbered.where("place > 0").groupBy("file", "place").agg(title, body).select("file", "place", "title", told.alias("scope"), F.regexp_replace("content", r"^\s+|\s+$", "").alias("content"))


def first_of(spark: SparkSession, root: str, names: tuple[str, ...]) -> str | None:
    """The first of some files that stands below a folder."""
    return next((f"{root}/{n}" for n in names if fs.exists(spark, f"{root}/{n}")), None)


def instructions(spark: SparkSession, root: str, most: int = MOST_INSTRUCTIONS) -> str | None:
    """The text of the first instruction file that has one, cut with a note; None where there is none."""
    for name in INSTRUCTIONS:
        text = fs.read_text(spark, f"{root}/{name}").strip() if fs.exists(spark, f"{root}/{name}") else ""
        if text:
            return text if len(text) <= most else f"{text[:most]}\n\n[... {name} truncated at {most} chars]"
    return None


def lines_of(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """path, first, last, text, problem: the wanted lines (path, first, last; null: from the start, to the end) of files (path, contents).

    Paths that lead out of the folder, and credential files, are not shown.
    """
    outside = F.col("path").startswith("/") | F.col("path").rlike(r"(^|/)\.\.(/|$)|^[A-Za-z]:")
    asked = wanted.withColumn("problem", F.when(outside, "outside").when(X.is_key_path(F.col("path")), "credential"))
    lines = F.split("contents", "\n")
    begin = F.greatest(F.coalesce("first", F.lit(1)), F.lit(1))
    count = F.greatest(F.least(F.coalesce("last", F.size(lines)), F.size(lines)) - begin + 1, F.lit(0))
    text = F.when(F.col("problem").isNull(), F.array_join(F.slice(lines, begin, count), "\n"))
    return asked.join(files.select("path", "contents"), "path", "left").select("path", "first", "last", text.alias("text"), F.when(F.col("problem").isNull() & F.col("contents").isNull(), "missing").otherwise(F.col("problem")).alias("problem"))


def _git(root: str, *command: str) -> str:
    """Output of a git command on the driver; empty where there is no repository."""
    try:
        return subprocess.run(["git", "-C", root, *command], capture_output=True, text=True, timeout=15, check=True).stdout
    except (OSError, subprocess.SubprocessError):
        return ""


def git_state(root: str) -> dict[str, str | None]:
    """branch and commit of a folder on the driver; None where it is no repository."""
    return {"branch": _git(root, "rev-parse", "--abbrev-ref", "HEAD").strip() or None, "commit": _git(root, "rev-parse", "HEAD").strip() or None}


def git_commits(spark: SparkSession, root: str, window_days: int = 30) -> DataFrame:
    """path, ts of the commits that touched each file within the window; ranking.recency() makes scores of them."""
    return parsed_log(spark.createDataFrame([(_git(root, "log", "--name-only", "--format=%at", f"--since={window_days} days ago"),)], "log string"))


def parsed_log(logs: DataFrame) -> DataFrame:
    """path, ts from logs (log): a line with a commit's seconds, then the paths that it touched."""
    blocks = F.filter(F.split("log", r"(?m)^(?=\d+$)"), lambda b: b != "")
    rows = logs.select(F.explode(blocks).alias("block")).select(F.split("block", "\n").alias("lines")).where(F.col("lines")[0].rlike(r"^\d+$"))
    paths = F.filter(F.transform(F.slice("lines", 2, 1 << 30), lambda x: F.trim(x)), lambda x: x != "")
    return rows.select(F.explode(paths).alias("path"), F.timestamp_seconds(F.col("lines")[0].cast("long")).alias("ts"))


class AuditSink:
    """Appends to a log of JSON lines whose records are chained by hashes; goes on behind the last whole one, on a line of its own.  One writer only: the driver, on its own disk."""

    def __init__(self, path: str, most_chars: int = 2000):
        self.path, self.most_chars, self.seq, self.before, self.failures = path, most_chars, 0, "", 0
        self.torn = False  # does a record end the log that was not written whole?
        try:
            os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
            self._resume()
        except FileNotFoundError:
            pass
        except OSError:
            self.failures += 1

    def _resume(self) -> None:
        """Finds the last whole record, reading backwards as far as it takes."""
        size, window = os.path.getsize(self.path), 1 << 16
        while True:
            with open(self.path, "rb") as file:
                file.seek(max(0, size - window))
                text = file.read().decode(errors="replace")
            self.torn = bool(text) and not text.endswith("\n")
            for line in reversed(text.split("\n")):
                try:
                    record = json.loads(line)
                    self.seq, self.before = int(record["seq"]), str(record["hash"])
                    return
                except (ValueError, KeyError, TypeError):
                    continue
            if window >= size:
                self.failures += bool(text.strip())
                return
            window *= 4

    def log(self, kind: str, ts: str, **data) -> dict | None:
        """Writes one record; None, and a failure counted, where that is not possible."""
        cut = lambda v: v[: self.most_chars] + f"…[+{len(v) - self.most_chars} chars]" if isinstance(v, str) and len(v) > self.most_chars else v
        text = json.dumps({k: cut(v) for k, v in data.items()}, sort_keys=True, ensure_ascii=False)
        record = {"seq": self.seq + 1, "ts": ts, "type": kind, "data": text, "prev": self.before}
        record["hash"] = hashlib.sha256("|".join((str(record["seq"]), ts, kind, text, self.before)).encode()).hexdigest()
        try:
            with open(self.path, "a", encoding="utf-8") as file:
                file.write(("\n" if self.torn else "") + json.dumps(record, ensure_ascii=False) + "\n")
            self.torn = False
        except OSError:
            self.failures += 1
            return None
        self.seq, self.before = record["seq"], record["hash"]
        return record


def json_store(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Documents of a folder of JSON files, one each, newest first by updated_at."""
    return spark.read.schema(schema).option("multiLine", True).json(folder).orderBy(F.desc("updated_at"), "id")


def save_json(spark: SparkSession, folder: str, name: str, document: dict) -> None:
    fs.write_text(spark, f"{folder}/{name}.json", json.dumps(document, ensure_ascii=False), overwrite=True)


def remove_json(spark: SparkSession, folder: str, name: str) -> bool:
    if not fs.exists(spark, f"{folder}/{name}.json"):
        return False
    fs.delete(spark, f"{folder}/{name}.json")
    return True


def write_results(results: DataFrame, path: str) -> None:
    """Results as JSON lines."""
    results.write.mode("overwrite").json(path)


def agent_tasks(document: str) -> list[dict]:
    """Checked tasks from JSON text: an array, or an object with tasks; files lie inside the workspace."""
    found = json.loads(document)
    tasks = found.get("tasks") if isinstance(found, dict) else found
    if not isinstance(tasks, list) or not tasks:
        raise ValueError("no tasks")
    for n, task in enumerate(tasks):
        for key, kind in (("id", str), ("instruction", str), ("files", dict)):
            if not isinstance(task.get(key), kind) or not task[key]:
                raise ValueError(f"task {n}: {key} is required")
        command = (task.get("verify") or {}).get("command")
        if not isinstance(command, str) or not command.strip():
            raise ValueError(f"task {n}: verify.command is required")
        for path in task["files"]:
            if re.match(r"[A-Za-z]:|[\\/]", path) or ".." in re.split(r"[\\/]+", path):
                raise ValueError(f"task {n}: {path} must be a relative path inside the workspace")
    return tasks


def settings(layers: list[dict]) -> dict:
    """Settings from layers, a later one over the earlier ones, key by key; None says nothing."""
    out: dict = {}
    for layer in layers:
        for key, value in layer.items():
            if isinstance(value, dict):
                out[key] = settings([out.get(key, {}) if isinstance(out.get(key), dict) else {}, value])
            elif value is not None:
                out[key] = value
    return out


def policy_rows(documents: list[tuple[str, str]]) -> list[tuple]:
    """RULES rows of policy.merged() from (source, JSON text) in their order; a document that does not parse is an error."""
    out = []
    for place, (source, text) in enumerate(documents):
        d = json.loads(text)
        agent, embedding = d.get("agent", {}), d.get("embedding", {})
        shell = agent.get("shell", {})
        out.append(("", place, source, agent.get("edits", {}).get("enabled"), shell.get("enabled"), shell.get("allowlist"), shell.get("maxTimeoutMs"), shell.get("sandbox"), agent.get("webSearch", {}).get("enabled"), embedding.get("allowedProviders"), embedding.get("localOnly"), d.get("ignore"), d.get("audit", {}).get("required")))
    return out


def eval_cases(document: str) -> list[dict]:
    """Checked evaluation cases from JSON text: an array, or an object with cases."""
    found = json.loads(document)
    cases = found["cases"] if isinstance(found, dict) else found
    out, seen = [], set()
    for case in cases:
        expected = case.get("expectedPaths", case.get("expected"))
        if not case.get("id") or not case.get("query") or not isinstance(expected, list):
            raise ValueError(f"not a case: {case}")
        if case["id"] in seen:
            raise ValueError(f"two cases are named {case['id']}")
        seen.add(case["id"])
        out.append({"id": case["id"], "query": case["query"], "expected": [p.replace("\\", "/") for p in expected]})
    return out


def export_index(tables: dict[str, DataFrame], path: str, manifest: dict) -> None:
    """Writes an index's tables as Parquet, and its manifest last, so that a torn export is not read."""
    for name, frame in tables.items():
        frame.write.mode("overwrite").parquet(f"{path}/{name}")
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(json.dumps(manifest | {"tables": sorted(tables)}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/_manifest")


def import_index(spark: SparkSession, path: str, **expected) -> dict[str, DataFrame]:
    """Reads an exported index whose manifest agrees with what is expected (model, dim, version, ...)."""
    manifest = json.loads(spark.read.text(f"{path}/_manifest").first()[0])
    for key, value in expected.items():
        if manifest.get(key) != value:
            raise ValueError(f"{key} is {manifest.get(key)!r}, not {value!r}")
    missing = [name for name in manifest["tables"] if not fs.exists(spark, f"{path}/{name}/_SUCCESS")]
    if missing:
        raise ValueError(f"incomplete: {', '.join(missing)}")
    return {name: spark.read.parquet(f"{path}/{name}") for name in manifest["tables"]}
