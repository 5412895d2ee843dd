"""Session logs as tables: catalogue, lines, documents, and append-only event files."""

from __future__ import annotations

import os
from urllib.parse import unquote, urlparse

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..functions import text as T

#: Fixed limits: bytes of a session, characters of a line, bytes of a document.
MAX_SESSION_BYTES = 50 * 1024 * 1024
MAX_LINE_CHARS = 1024 * 1024
MAX_DOCUMENT_BYTES = 64 * 1024
MINED_BYTES = (10 * 1024, 8 * 1024 * 1024)
#: Written nowhere if this variable is exactly "1".
NO_EVENTS = "TRACELOOM_NO_EVENTS"


def _local(path: str) -> str | None:
    """The path in a local file system, if the URI is of one; other stores have no links."""
    uri = urlparse(path)
    return unquote(uri.path) if uri.scheme in ("", "file") else None


def is_regular(root: str, follow: bool = False) -> object:
    """A function on paths: a regular file under ``root`` that no link on the way from there leads to.

    With ``follow`` links are resolved, and what they lead to must still lie under the real root.
    """
    @pandas_udf("boolean")
    def check(paths: pd.Series) -> pd.Series:
        top = _local(root)

        def sound(path: str) -> bool:
            p = _local(path)
            if p is None or top is None:
                return True
            real, base = os.path.realpath(p), os.path.realpath(top)
            if not os.path.isfile(p) or os.path.islink(p) or not (real == base or real.startswith(base + os.sep)):
                return False
            return follow or os.path.relpath(real, base) == os.path.relpath(os.path.abspath(p), os.path.abspath(top))

        return paths.map(sound)

    return check


def catalog(spark: SparkSession, root: str, agent: str, recursive: bool = False) -> DataFrame:
    """``session_id, agent, path, modified_at, size_bytes`` of the ``*.jsonl`` files; contents are not read.

    Files lie two levels deep, or at any depth where ``recursive``. Links, and what lies
    behind linked folders, are left out, and so are files that are gone or may not be read;
    a root that does not exist has no sessions.
    """
    reader = spark.read.format("binaryFile").option("pathGlobFilter", "*.jsonl").option("ignoreMissingFiles", "true")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not (store.globStatus(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root, "*")) or []):
        return spark.createDataFrame([], "session_id string, agent string, path string, modified_at timestamp, size_bytes long")
    files = reader.option("recursiveFileLookup", "true").load(root) if recursive else reader.load(f"{root.rstrip('/')}/*")
    name = F.regexp_extract("path", r"([^/]+)\.jsonl$", 1)
    files = files.where(is_regular(root)(F.col("path")))
    return files.select(name.alias("session_id"), F.lit(agent).alias("agent"), "path", F.col("modificationTime").alias("modified_at"), F.col("length").alias("size_bytes"))


def every_catalog(spark: SparkSession, claude_root: str, codex_root: str, agent: str | None = None, limit: int = 20) -> DataFrame:
    """The last modified sessions of both kinds of logs, or of one."""
    kinds = [("claude-code", claude_root, False), ("codex", codex_root, True)]
    found = [catalog(spark, root, name, recursive) for name, root, recursive in kinds if agent in (None, name)]
    if not found:
        raise ValueError(f"unknown agent {agent!r}")
    return newest(found[0] if len(found) == 1 else found[0].unionByName(found[1]), limit)


def trusted(sessions: DataFrame, root: str) -> DataFrame:
    """Adds ``trusted``: whether a session's file is no link and lies under ``root`` with all links resolved."""
    return sessions.withColumn("trusted", is_regular(root, follow=True)(F.col("path")))


def scan_counts(sessions: DataFrame, parsed: DataFrame, low: int = MINED_BYTES[0], high: int = MINED_BYTES[1]) -> DataFrame:
    """One row ``scanned, skipped_size, skipped_parse, parsed``: files of another size, and those without a message in ``parsed (session_id)``."""
    sized = F.col("size_bytes").between(low, high)
    got = sessions.join(parsed.select("session_id", F.lit(True).alias("_p")).distinct(), "session_id", "left")
    return got.agg(F.count("*").alias("scanned"), F.count_if(~sized).alias("skipped_size"), F.count_if(sized & F.col("_p").isNull()).alias("skipped_parse"), F.count_if(sized & F.col("_p")).alias("parsed"))


def newest(sessions: DataFrame, limit: int = 20) -> DataFrame:
    """The last modified sessions first; ties by path."""
    return sessions.orderBy(F.desc("modified_at"), "path").limit(limit)


def lookup(sessions: DataFrame, wanted: str) -> DataFrame:
    """``latest``, or the newest session among 100 whose id begins with ``wanted``."""
    top = newest(sessions, 100)
    return newest(top if wanted == "latest" else top.where(F.col("session_id").startswith(F.lit(wanted))), 1)


def within(sessions: DataFrame, low: int = 0, high: int = MAX_SESSION_BYTES) -> DataFrame:
    """Sessions of a size between the two, both included."""
    return sessions.where(F.col("size_bytes").between(low, high))


def numbered(lines: Column, most: int = MAX_LINE_CHARS) -> Column:
    """Lines with their numbers; those of more UTF-16 units are left out."""
    pairs = F.transform(F.split(lines, "\n"), lambda x, i: F.struct(i.alias("line_no"), x.alias("line")))
    units = lambda x: F.length(x) + F.regexp_count(x, F.lit(r"[\x{10000}-\x{10FFFF}]"))
    return F.filter(pairs, lambda p: F.when(F.octet_length(p["line"]) <= most, True).otherwise(units(p["line"]) <= most))


def lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``path, line_no, line`` of log files. A file is one row first, so sizes are to be checked with ``within``."""
    whole = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), T.trim(F.col("value")).alias("v"))
    return whole.select("path", F.inline(numbered(F.col("v"))))


def documents(spark: SparkSession, folder: str, most: int = 1000) -> DataFrame:
    """``path, text`` of the Markdown files of a flat folder: the first ``most`` entries by path, small ones only, no links or empty files."""
    every = spark.read.format("binaryFile").load(folder).select("path", "length", "content")
    first = every.orderBy("path").limit(most).where(F.col("path").endswith(".md") & (F.col("length") <= MAX_DOCUMENT_BYTES))
    return first.where(is_regular(folder)(F.col("path"))).select("path", F.decode("content", "UTF-8").alias("text"))


def append_events(events: DataFrame, folder: str) -> None:
    """Appends events as JSON lines, unless the variable ``NO_EVENTS`` is exactly "1"."""
    if os.environ.get(NO_EVENTS) != "1":
        events.write.mode("append").json(folder)


def created_events(documents: DataFrame, agent_name: str = "traceloom") -> DataFrame:
    """An event for each written document ``name, path, session_id, agent, input_tokens, output_tokens, mode, ts``.

    Ids come from the row, so that reruns agree.
    """
    key = F.sha2(F.concat_ws("\x1f", "session_id", "name"), 256)
    attrs = F.struct(
        F.col("session_id").alias("source_session"), F.col("agent").alias("source_agent"), F.col("name").alias("skill_name"), F.col("path").alias("skill_path"),
        F.col("input_tokens").alias("token_cost_input"), F.col("output_tokens").alias("token_cost_output"), F.col("mode").alias("distill_mode"),
    )
    return documents.select(
        F.lit("0.1").alias("schema_version"), F.concat(F.lit("evt_"), F.substring(key, 1, 12)).alias("event_id"), F.concat(F.lit("run_"), F.substring("session_id", 1, 8)).alias("run_id"),
        "ts", F.lit("skill.created").alias("type"), F.lit(agent_name).alias("agent_name"), attrs.alias("attrs"),
    )


def write_documents(documents: DataFrame, folder: str, force: bool = False) -> DataFrame:
    """Writes ``documents (name, document)`` as ``<name>.md`` of a local or mounted folder; ``name, path, code``.

    Code 0: written; 3: the path would leave the folder; 4: a link or, without ``force``, a file is there.
    Files are created exclusively, one document after another in a task; ``name`` tells rows apart.
    """
    top = _local(folder)
    if top is None:
        raise ValueError("documents are files of a local or mounted folder")

    def run(batches):
        os.makedirs(top, exist_ok=True)
        base = os.path.abspath(top)
        for pdf in batches:
            out = []
            for name, text in zip(pdf["name"], pdf["document"], strict=True):
                path = os.path.abspath(os.path.join(base, f"{name}.md"))
                code = 0
                if not path.startswith(base + os.sep):
                    code = 3
                elif os.path.islink(path) or (os.path.exists(path) and not (force and os.path.isfile(path))):
                    code = 4
                else:
                    try:
                        with open(path, "w" if force else "x", encoding="utf-8", newline="") as f:
                            f.write(text or "")
                    except FileExistsError:
                        code = 4
                out.append((name, path, code))
            yield pd.DataFrame(out, columns=["name", "path", "code"])

    # one copy of the results is kept, so that reading them again writes nothing again
    done = documents.select("name", "document").mapInPandas(run, "name string, path string, code int").collect()
    return documents.sparkSession.createDataFrame(done, "name string, path string, code int")


def mined_sessions(spark: SparkSession, path: str) -> DataFrame:
    """Sessions of a JSON array that ``reports.mined_json`` or the like has written, as ``mining.score`` takes them."""
    session = "struct<sessionId string, project string, branch string, startedAt string, endedAt string, totalToolCalls bigint, filesModified array<string>, totalTokens struct<input bigint, output bigint>, summary struct<userMessages bigint, uniqueTools array<string>>>"
    schema = f"filePath string, sizeKb bigint, score bigint, scoreReasons array<string>, firstUserMessage string, lastAssistantMessage string, durationSec bigint, session {session}"
    rows = spark.read.schema(schema).json(path, multiLine=True)
    files = F.col("session.filesModified")
    return rows.select(
        F.col("session.sessionId").alias("session_id"), F.col("filePath").alias("path"), F.col("sizeKb").alias("size_kb"), "score", F.col("scoreReasons").alias("reasons"), F.col("session.summary.userMessages").alias("users"),
        F.col("session.totalToolCalls").alias("tools"), F.size(files).cast("long").alias("files"), T.has_code_file(files).alias("code"), T.has_code_file(files, config=True).alias("code_or_config"),
        F.col("durationSec").alias("duration"), F.col("session.totalTokens.input").alias("tokens"), F.contains(F.col("session.project"), F.lit("/Projects/")).alias("in_projects"),
        F.exists("scoreReasons", lambda r: F.contains(r, F.lit("slash-only"))).alias("slash_only"), T.clean_intent(F.col("firstUserMessage")).alias("intent"), F.col("session.project").alias("project"),
    )
