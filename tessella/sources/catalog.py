"""Sources and sinks: the JSONL journal, case files, run tables with blobs, connectors with recorded responses."""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.pages import mapped
from ..functions.pdf import no_text_layer, read_pdfs, typeset
from ..plans.registry import register
from ..plans.scratch import scratch_path

JOURNAL_SCHEMA = "run_id string, seq long, kind string, type string, call_key string, data string, cents long, at_ms long"


#: Folders of a journal of many runs.
BUCKETS = 64


def safe_name(name: Column) -> Column:
    return F.regexp_replace(name, r"[^\w.-]", "_")


def sequenced(entries: DataFrame, after: DataFrame | None = None, by: str = "at_ms") -> DataFrame:
    """Entries numbered within their run in the order of ``by``, behind the last number that the journal ``after`` has of the run."""
    k = F.row_number().over(Window.partitionBy("run_id").orderBy(by, "type", "data"))
    if after is None:
        return entries.withColumn("seq", (k - 1).cast("long"))
    last = after.groupBy("run_id").agg(F.max("seq").alias("__last"))
    return entries.join(last, "run_id", "left").withColumn("seq", (k + F.coalesce("__last", F.lit(-1))).cast("long")).drop("__last")


def journal_bucket(run: Column, buckets: int = BUCKETS) -> Column:
    """The folder ``bucket=`` of a run in a journal with so many."""
    return F.pmod(F.xxhash64(safe_name(run)), F.lit(buckets)).cast("int")


def append_journal(entries: DataFrame, path: str, buckets: int = 0) -> None:
    """Append entries as JSON lines; failed writes raise.

    A folder for each run, or, for more than a few runs, so many buckets of runs, a file or some for each however many runs and tasks there are; a large run
    is spread over tasks. A journal keeps the layout it began with."""
    if not buckets:
        entries.withColumn("run", safe_name(F.col("run_id"))).write.mode("append").partitionBy("run").json(path)
        return
    dealt = entries.withColumn("bucket", journal_bucket(F.col("run_id"), buckets)).hint("rebalance", "bucket")
    dealt.write.mode("append").partitionBy("bucket").json(path)


def read_journal(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a journal, lines that don't parse left out; ``seq`` has their order within a run."""
    return spark.read.schema(JOURNAL_SCHEMA).option("mode", "DROPMALFORMED").json(path)


def journal_runs(spark: SparkSession, path: str) -> DataFrame:
    """(run, files): the runs that a journal folder holds and how many files have some of each: by the names of their folders, without a look into the files; in buckets by the names in the lines, counted where they lie."""
    paths = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    named = paths.where("path LIKE '%/run=%'").select(F.regexp_extract("path", "/run=([^/]+)/", 1).alias("run"), "path")
    lines = spark.read.schema("run_id string").option("mode", "DROPMALFORMED").option("recursiveFileLookup", "true").json(path)
    held = lines.where("_metadata.file_path LIKE '%/bucket=%'").select(safe_name(F.col("run_id")).alias("run"), F.col("_metadata.file_path").alias("path")).distinct()
    return named.unionByName(held).groupBy("run").agg(F.count("*").alias("files"))


def runs_of(journal: DataFrame) -> DataFrame:
    return journal.select("run_id").distinct()


def run_status(journal: DataFrame) -> DataFrame:
    """Completed or failed by the last terminal event, else incomplete; with the first meta entry's data."""
    ends = journal.where("type IN ('run.completed', 'run.error')").groupBy("run_id").agg(F.max_by("type", "seq").alias("last"))
    first = journal.where("kind = 'meta'").groupBy("run_id").agg(F.min_by("data", "seq").alias("question"))
    state = F.when(F.col("last") == "run.completed", "completed").when(F.col("last") == "run.error", "failed").otherwise("incomplete")
    return runs_of(journal).join(ends, "run_id", "left").join(first, "run_id", "left").select("run_id", state.alias("status"), "question")


def read_cases(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Cases from a JSON array, JSON lines with # comments, or CSV with a header and quoted line breaks, by what the file looks like."""
    if path.endswith(".csv"):
        return spark.read.schema(schema).csv(path, header=True, multiLine=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False).dropna("all")
    # by the text itself, whatever the name: files that begin with a bracket are arrays
    if spark.read.text(path, wholetext=True).where(F.startswith(F.ltrim("value"), F.lit("["))).limit(1).count():
        return spark.read.schema(schema).json(path, multiLine=True)
    lines = spark.read.text(path).where("trim(value) <> '' AND NOT startswith(trim(value), '#')")
    return lines.select(F.from_json("value", schema).alias("c")).select("c.*")


def write_jsonl(rows: DataFrame, path: str) -> None:
    """Rows as JSON lines; null columns are left out of a line."""
    rows.write.mode("overwrite").json(path)


def trace_files(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Spans of trace files ``<commit>/<run>.trace.json``, commit and run by the names of folder and file."""
    files = spark.read.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").json(path)
    name = lambda group: F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]+)/([^/]+)\.trace(?:/|\.json)", group)
    return files.select("*", name(1).alias("commit"), name(2).alias("run"))


def unloaded(rows: DataFrame, loaded: DataFrame, key: str = "revision") -> DataFrame:
    """Rows of dataset revisions that the meta table doesn't know yet: a load that is repeated adds nothing."""
    return rows.join(loaded.select(key), key, "left_anti")


def flattened(cases: DataFrame) -> DataFrame:
    """Criteria of rubrics: sections and their criteria as rows, those without finite weight or requirement left out, ids defaulted."""
    rows = cases.select("case_id", F.posexplode("sections").alias("s", "section")).select("case_id", "s", F.col("section.id").alias("section_id"), F.posexplode("section.criteria").alias("c", "criterion"))
    rows = rows.select("case_id", F.coalesce("section_id", F.concat(F.lit("section-"), F.col("s") + 1)).alias("section_id"), F.coalesce("criterion.id", F.concat(F.lit("criterion-"), F.col("c") + 1)).alias("id"), "criterion.weight", F.trim("criterion.requirement").alias("requirement"))
    return rows.where("weight IS NOT NULL AND NOT isnan(weight) AND abs(weight) < double('infinity') AND requirement <> ''")


def decrypted(secret: str, canary: str) -> str:
    """A field that was XORed with the repeated SHA-256 of its canary and written in base 64."""
    key, data = hashlib.sha256(canary.encode()).digest(), base64.b64decode(secret)
    return bytes(b ^ key[i % len(key)] for i, b in enumerate(data)).decode("utf-8")


def encrypted(text: str, canary: str) -> str:
    key = hashlib.sha256(canary.encode()).digest()
    return base64.b64encode(bytes(b ^ key[i % len(key)] for i, b in enumerate(text.encode()))).decode()


def abstract_text(index: DataFrame) -> DataFrame:
    """Abstracts from inverted indexes (id, map word to places): words in the order of their places."""
    words = index.select("id", F.explode("index").alias("word", "places")).select("id", "word", F.explode("places").alias("at"))
    return words.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("abstract"))


def persisted(usage: DataFrame, runs: DataFrame) -> DataFrame:
    """What is kept of a run: tokens by role as JSON, their sum, and why it ended."""
    roles = usage.groupBy("run_id", "role").agg(F.sum(F.col("input") + F.col("output")).alias("n"))
    kept = roles.groupBy("run_id").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("role", "n"))))).alias("usage"), F.sum("n").alias("tokens"))
    finish = F.when(F.col("status").isNull(), "lost").when(F.col("status") == "error", "error").when(F.col("exhausted"), "cap").otherwise("finished")
    return kept.join(runs, "run_id", "left").select("run_id", "usage", "tokens", finish.alias("finish"))


def direct_text(kind: Column, body: Column) -> Column:
    """A text body by content type: JSON reprinted, XML without tags, others as they are."""
    return F.when(kind.rlike("json"), F.coalesce(F.try_parse_json(body).cast("string"), body)).when(kind.rlike("xml"), F.trim(F.regexp_replace(F.regexp_replace(body, "<[^>]*>", " "), r"\s+", " "))).otherwise(body)


class RecordedReader(DataSourceReader):
    """Recorded responses of a connector, a partition for each shard of a JSON-lines file list."""

    def __init__(self, options):
        self.files = [f for f in options.get("files", "").split(",") if f]

    def partitions(self):
        return [InputPartition(f) for f in self.files] or [InputPartition(None)]

    def read(self, partition) -> Iterator[tuple]:
        if partition.value is None:
            return
        with open(partition.value, encoding="utf-8") as lines:
            for n, line in enumerate(lines):
                found = json.loads(line)
                yield found.get("query", ""), n + 1, found.get("url", ""), found.get("title", ""), found.get("snippet", "")


class RecordedSearch(DataSource):
    """``spark.read.format("recorded_search")``: what a search connector returned, for runs without a network."""

    @classmethod
    def name(cls) -> str:
        return "recorded_search"

    def schema(self) -> str:
        return "query string, position int, url string, title string, snippet string"

    def reader(self, schema) -> DataSourceReader:
        return RecordedReader(self.options)


def parsed_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """Results from lines ``url :: summary``, the first of each URL."""
    lines = df.select(key, F.posexplode(F.split(text, "\n")).alias("at", "line"))
    hits = lines.select(key, "at", F.regexp_extract("line", r"^\W*(https?://\S+)\s*::\s*(.*)$", 1).alias("url"), F.regexp_extract("line", r"^\W*(https?://\S+)\s*::\s*(.*)$", 2).alias("summary")).where("url <> ''")
    return hits.withColumn("r", F.row_number().over(Window.partitionBy(key, "url").orderBy("at"))).where("r = 1").drop("r", "at")


def _index(b: DataFrame) -> DataFrame:
    rows = b.select(F.col("item_id").alias("id"), F.posexplode(F.split("text", " ")).alias("at", "w")).groupBy("id", "w").agg(F.collect_list("at").alias("p"))
    return rows.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("w", "p"))).alias("index"))


STATUS = "SELECT run_id, CASE l WHEN 'run.completed' THEN 'completed' WHEN 'run.error' THEN 'failed' ELSE 'incomplete' END AS status, question FROM (SELECT run_id, arg_max(type, seq) FILTER (type IN ('run.completed', 'run.error')) AS l, arg_min(data, seq) FILTER (kind = 'meta') AS question FROM journal GROUP BY 1)"


def _journal_folder(j: DataFrame) -> str:
    path = scratch_path(j.sparkSession, "journal")
    append_journal(j, path, BUCKETS)
    return path


def _appended(j: DataFrame) -> DataFrame:
    """Two writes of one journal, the second behind the numbers of the first."""
    spark, path, bare = j.sparkSession, scratch_path(j.sparkSession, "journal"), j.drop("seq")
    append_journal(sequenced(bare.where("at_ms % 3 > 0")), path, BUCKETS)
    append_journal(sequenced(bare.where("at_ms % 3 = 0"), read_journal(spark, path)), path, BUCKETS)
    return read_journal(spark, path).groupBy("run_id").agg(F.count("*").alias("entries"), F.count_distinct("seq").alias("numbers"), F.max("seq").alias("last"), F.max(F.when(F.col("at_ms") % 3 > 0, F.col("seq"))).alias("last_of_first"))


CASE = "id long, problem string, domain string"


def _cases(b: DataFrame) -> DataFrame:
    return b.select(F.col("item_id").alias("id"), F.concat(F.lit('He said "'), "text", F.lit('",\nand\tmore')).alias("problem"), F.concat(F.lit("d"), F.col("item_id") % 5).alias("domain"))


def _written_cases(b: DataFrame, kind: str) -> DataFrame:
    """Cases written as a file of this kind and read again by read_cases()."""
    spark, rows = b.sparkSession, _cases(b)
    path = scratch_path(spark, "cases") + (".csv" if kind == "csv" else "")
    if kind == "csv":
        rows.write.csv(path, header=True, quote='"', escape='"')
    elif kind == "array":  # some arrays of bounded size, a file each
        lines = rows.groupBy(F.col("id") % 16).agg(F.to_json(F.collect_list(F.struct("id", "problem", "domain"))).alias("value"))
        lines.select("value").write.option("maxRecordsPerFile", 1).text(path)
    else:
        lines = rows.select(F.explode(F.array(F.lit("# a comment"), F.lit("  "), F.to_json(F.struct("id", "problem", "domain")))).alias("value"))
        lines.write.text(path)
    return read_cases(spark, path, CASE).select("id", F.md5("problem").alias("digest"), "domain")


def _files(d: DataFrame, lines: int = 30) -> DataFrame:
    """(path, content): each document's text as a PDF file, so many lines a page."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            made = []
            for text in batch.column(1).to_pylist():
                every = text.split("\n")
                made.append(typeset(["\n".join(every[i : i + lines]) for i in range(0, len(every), lines)]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["path", "content"])

    return d.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "path long, content binary")


def _sunk(r: DataFrame) -> DataFrame:
    """A manifest, results and a summary as the lines of one file, read again."""
    spark, path = r.sparkSession, scratch_path(r.sparkSession, "results")
    lit = lambda x: F.lit(x).alias("type")
    manifest = r.select("commit_sha").distinct().select(lit("manifest"), "commit_sha")
    results = r.select(lit("result"), "commit_sha", "run_id", "normalized")
    summary = r.groupBy("commit_sha").agg(F.count("*").alias("total")).select(lit("summary"), "commit_sha", "total")
    write_jsonl(manifest.unionByName(results, allowMissingColumns=True).unionByName(summary, allowMissingColumns=True), path)
    return spark.read.schema("type string, commit_sha string, run_id string, normalized double, total long").json(path)


def _traced(s: DataFrame) -> DataFrame:
    spark, path = s.sparkSession, scratch_path(s.sparkSession, "traces")
    for commit in ("k1", "k2"):
        for run in ("run1", "run2", "run3"):
            s.where(F.col("run_id") == run).where(F.col("id") % 2 == int(commit[1]) % 2).select("id", "kind", "duration_ms").write.json(f"{path}/{commit}/{run}.trace")
    return trace_files(spark, path, "id long, kind string, duration_ms long").groupBy("commit", "run").agg(F.count("*").alias("spans"), F.sum("duration_ms").alias("ms"))


CASES_SQL = """SELECT item_id AS id, md5('He said "' || text || '",' || chr(10) || 'and' || chr(9) || 'more') AS digest, 'd' || (item_id % 5) AS domain FROM benchmark"""

register("sc01_journal_append", "journal", _appended, "SELECT run_id, count(*) AS entries, count(*) AS numbers, count(*) - 1 AS last, nullif(count(*) FILTER (at_ms % 3 > 0) - 1, -1) AS last_of_first FROM journal GROUP BY 1")
register("sc02_journal_scan", "journal", lambda j: read_journal(j.sparkSession, _journal_folder(j)).groupBy("run_id").agg(F.count("*").alias("entries"), F.max("seq").alias("last")), "SELECT run_id, count(*) AS entries, max(seq) AS last FROM journal GROUP BY 1")
register("sc03_run_list", "journal", lambda j: journal_runs(j.sparkSession, _journal_folder(j.withColumn("run_id", F.concat("run_id", F.lit("/a b"))))).select("run"), "SELECT DISTINCT run_id || '_a_b' AS run FROM journal")
register("sc05_case_array", "benchmark", lambda b: _written_cases(b, "array"), CASES_SQL)
register("sc06_case_lines", "benchmark", lambda b: _written_cases(b, "lines"), CASES_SQL)
register("sc07_case_csv", "benchmark", lambda b: _written_cases(b, "csv"), CASES_SQL)
register("sc16_trace_files", "spans", _traced, "SELECT 'k' || c AS commit, run_id AS run, count(*) AS spans, sum(duration_ms)::BIGINT AS ms FROM spans, (VALUES (1), (2)) v(c) WHERE run_id IN ('run1', 'run2', 'run3') AND id % 2 = c % 2 GROUP BY 1, 2")
register("xs01_run_status", "journal", run_status, STATUS)
register("xs02_first_meta", "journal", lambda j: run_status(j).where("question IS NOT NULL").select("run_id", "question"), f"SELECT run_id, question FROM ({STATUS}) WHERE question IS NOT NULL")
register("pf24_rubric_rows", "cases", lambda c: flattened(c.select("case_id", F.array(F.struct(F.lit(None).cast("string").alias("id"), F.array(F.struct(F.lit("a").alias("id"), F.col("criteria_count").cast("double").alias("weight"), F.lit(" must hold ").alias("requirement")), F.struct(F.lit(None).cast("string").alias("id"), F.lit(None).cast("double").alias("weight"), F.lit("x").alias("requirement"))).alias("criteria"))).alias("sections"))), "SELECT case_id, 'section-1' AS section_id, 'a' AS id, criteria_count::DOUBLE AS weight, 'must hold' AS requirement FROM cases")
register("sc26_abstracts", "benchmark", lambda b: abstract_text(_index(b)), "SELECT item_id AS id, array_to_string(string_split(text, ' '), ' ') AS abstract FROM benchmark")
register("sc23_parse_lines", "hits", lambda h: parsed_lines(h.select("hit_id", F.concat_ws("\n", F.lit("found:"), F.concat(F.lit("- "), "url", F.lit(" :: "), "title"), F.concat("url", F.lit(" :: again")), F.lit("no result")).alias("text")), "hit_id", "text"), "SELECT hit_id, url, title AS summary FROM hits")
register("sc27_filing_urls", "orders", lambda o: o.select("o_orderkey", F.concat(F.lit("https://filings.example/data/"), "o_custkey", F.lit("/"), F.replace(F.format_string("%010d-%02d", "o_orderkey", F.col("o_orderkey") % 100), F.lit("-"), F.lit("")), F.lit("/index.htm")).alias("url")), "SELECT o_orderkey, 'https://filings.example/data/' || o_custkey || '/' || replace(printf('%010d-%02d', o_orderkey, o_orderkey % 100), '-', '') || '/index.htm' AS url FROM orders")
register("sc31_text_layer", "documents", lambda d: d.select("doc_id", no_text_layer(F.col("doc_id") % 30, F.length(F.regexp_replace("text", r"[^A-Za-z0-9]", ""))).alias("scanned")), "SELECT doc_id, doc_id % 30 >= 2 AND length(regexp_replace(text, '[^A-Za-z0-9]', '', 'g')) < greatest(200, 20 * (doc_id % 30)) AS scanned FROM documents")
register("sc31_pdf_text", "documents", lambda d: read_pdfs(_files(d)).withColumnRenamed("path", "doc_id"), """SELECT doc_id, pages, CASE WHEN NOT scanned THEN t END AS text, scanned FROM (SELECT *, pages >= 2 AND length(regexp_replace(t, '[^\\p{L}\\p{N}]', '', 'g')) < greatest(200, 20 * pages) AS scanned FROM
  (SELECT doc_id, (len(l) + 29) // 30 AS pages, array_to_string(list_transform(range(0, len(l), 30), lambda i: trim(array_to_string(l[i + 1 : i + 30], chr(10)), chr(10))), chr(10) || chr(10)) AS t FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)))""")
register("sc32_direct_text", "events", lambda e: e.select("event_id", F.when(F.col("event_id") % 3 == 0, F.lit("application/json")).when(F.col("event_id") % 3 == 1, F.lit("text/xml")).otherwise(F.lit("text/plain")).alias("t"), F.when(F.col("event_id") % 3 == 1, F.concat(F.lit("<a>"), "event_type", F.lit("</a><b> x </b>"))).otherwise(F.col("props")).alias("b")).select("event_id", F.regexp_replace(direct_text(F.col("t"), F.col("b")), r"\s", "").alias("text")), "SELECT event_id, CASE WHEN event_id % 3 = 1 THEN event_type || 'x' ELSE replace(props, ' ', '') END AS text FROM events")
register("sc36_decrypt", "benchmark", lambda b: mapped(b.select("item_id", "text"), "item_id long, text string", lambda i, t: (i, decrypted(encrypted(t, f"canary{i}"), f"canary{i}"))), "SELECT item_id, text FROM benchmark")
register("sc08_union_sink", "runs", _sunk, "SELECT DISTINCT 'manifest' AS type, commit_sha, NULL::VARCHAR AS run_id, NULL::DOUBLE AS normalized, NULL::BIGINT AS total FROM runs UNION ALL SELECT 'result', commit_sha, run_id, normalized, NULL FROM runs UNION ALL SELECT 'summary', commit_sha, NULL, NULL, count(*) FROM runs GROUP BY 2")
register("sc35_catalog_guard", "cases runs", lambda c, r: unloaded(c.withColumn("revision", F.concat(F.lit("k"), F.col("criteria_count") % 8)), r.select(F.col("commit_sha").alias("revision")).distinct()).select("case_id", "revision"), "SELECT case_id, 'k' || (criteria_count % 8) AS revision FROM cases WHERE 'k' || (criteria_count % 8) NOT IN (SELECT commit_sha FROM runs)")
register("xs47_persist_run", "usage runs", lambda u, r: persisted(u, r.groupBy(F.concat(F.lit("run"), F.col("created_at") % 13).alias("run_id")).agg(F.min("status").alias("status"), F.bool_and("exhausted").alias("exhausted"))), "SELECT run_id, '{' || string_agg('\"' || role || '\":' || n, ',' ORDER BY role) || '}' AS usage, sum(n)::BIGINT AS tokens, any_value(CASE WHEN status IS NULL THEN 'lost' WHEN status = 'error' THEN 'error' WHEN exhausted THEN 'cap' ELSE 'finished' END) AS finish FROM (SELECT run_id, role, sum(input + output)::BIGINT AS n FROM usage GROUP BY 1, 2) LEFT JOIN (SELECT 'run' || (created_at % 13) AS run_id, min(status) AS status, bool_and(exhausted) AS exhausted FROM runs GROUP BY 1) USING (run_id) GROUP BY 1")
register("xs44_trace_commits", "runs", lambda r: r.groupBy("commit_sha").agg(F.count("*").alias("n")), "SELECT commit_sha, count(*) AS n FROM runs GROUP BY 1")
