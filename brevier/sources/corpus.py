"""The article corpus: JSON documents in and out, and the inventory table with atomic replacement.

The inventory is a folder of versions. Each version is a Parquet folder of its own, and counts from the moment at
which its commit stands in `_versions`: a small file named by the version's number alone, which the store creates whole
and only where none is (`create_once`). So of several jobs that start from one version, one can make the next. The others
learn that they lost, and do their work again on what the winner left (`update_table`). A job that dies leaves the last
version in force, and at worst a folder that no commit names.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brevier.operators.merge import ARTICLE, COLUMNS, fill_defaults, running_number
from brevier.operators.rules import RulePack

DOCUMENT = (
    "generated_at string, sources_ok array<string>, sources_failed array<string>, "
    "official_results map<string, array<string>>, cleaned_noise map<string, bigint>, "
    "articles array<struct<" + ", ".join(": ".join(f.split()) for f in ARTICLE.split(", ")) + ">>, "
    "stats struct<total: bigint, by_category: map<string, bigint>, by_brand: map<string, bigint>, "
    "by_source: map<string, bigint>, by_source_type: map<string, bigint>, by_product_category: map<string, bigint>, "
    "timeline: array<struct<date: string, count: bigint>>, updated: string>"
)

#: A document of a corpus that many hold, with the place of its first article in the whole corpus.
PART = DOCUMENT + ", first bigint"


def read_document(spark: SparkSession, path: str, on_error: str = "raise") -> DataFrame:
    """One row a JSON document. A broken file raises, or gives no rows with on_error="empty"."""
    reader = spark.read.schema(DOCUMENT).option("multiLine", True).option("mode", "FAILFAST")
    if on_error == "raise":
        return reader.json(path)
    try:
        found = reader.json(path)
        found.count()
        return found
    except Exception:  # whatever is wrong with the file, the dashboard starts empty
        return spark.createDataFrame([], DOCUMENT)


def articles_of(documents: DataFrame, pack: RulePack, run_date: str) -> DataFrame:
    """Articles with their position, defaults filled in."""
    rows = documents.select(F.posexplode("articles").alias("pos", "article")).select("pos", "article.*")
    return fill_defaults(rows, pack, run_date)


def places_of(documents: DataFrame) -> DataFrame:
    """(pos, id) of articles: their place in the corpus, be it one document or many."""
    first = F.col("first") if "first" in documents.columns else F.lit(0)
    listed = documents.select(first.alias("first"), F.posexplode("articles.id").alias("pos", "id"))
    return listed.select((F.coalesce("first", F.lit(0)) + F.col("pos")).cast("int").alias("pos"), "id")


CLEANED = [
    "removed_howto", "removed_offtopic", "removed_no_real_date", "removed_celebrity_noise", "removed_brand_ambiguous",
    "date_corrected", "product_to_gnews", "removed_total",
]


def output_document(
    articles: DataFrame,
    stats: DataFrame,
    generated_at: str,
    sources_ok: list[str],
    sources_failed: list[str],
    official_results: dict[str, tuple[str, str]] | None = None,
    cleaned: DataFrame | None = None,
    most: int = 200_000,
) -> DataFrame:
    """One row in the form of a corpus document. It holds all articles, as its one reader, a browser, needs them.

    official_results: brand to (kind, url) of its source; cleaned: the row of merge.cleaning_report. More than `most`
    articles are no document for a browser, and refused: output_documents and write_articles take any number.
    """
    n = articles.limit(most + 1).count()
    if n > most:
        raise ValueError(f"over {most} articles don't fit one document: use output_documents or write_articles")
    listed = articles.agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct(F.struct(F.col("date"), (-F.col("id")).alias("n")).alias("k"), F.struct(*COLUMNS).alias("a"))), asc=False),
            lambda x: x["a"],
        ).alias("articles")
    )
    head = heading(stats, generated_at, sources_ok, sources_failed, official_results, cleaned)
    return listed.join(head).select("generated_at", "sources_ok", "sources_failed", "official_results", "cleaned_noise", "articles", "stats")


def heading(
    stats: DataFrame, generated_at: str, sources_ok: list[str], sources_failed: list[str],
    official_results: dict[str, tuple[str, str]] | None, cleaned: DataFrame | None,
) -> DataFrame:
    """One row: all of a document but its articles."""
    strings = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")
    told = [x for brand, pair in (official_results or {}).items() for x in (F.lit(brand), strings(pair))]
    results = F.create_map(*told) if told else F.lit(None)
    head = stats.select(F.struct("*").alias("stats"))
    if cleaned is None:
        head = head.withColumn("cleaned_noise", F.lit(None).cast("map<string, bigint>"))
    else:
        head = head.join(cleaned.select(F.create_map(*[x for c in CLEANED for x in (F.lit(c), F.col(c))]).alias("cleaned_noise")))
    return head.select(
        F.lit(generated_at).alias("generated_at"), strings(sources_ok).alias("sources_ok"),
        strings(sources_failed).alias("sources_failed"), results.cast("map<string, array<string>>").alias("official_results"),
        "cleaned_noise", "stats",
    )


def output_documents(
    articles: DataFrame,
    stats: DataFrame,
    generated_at: str,
    sources_ok: list[str],
    sources_failed: list[str],
    official_results: dict[str, tuple[str, str]] | None = None,
    cleaned: DataFrame | None = None,
    per_document: int = 10_000,
) -> DataFrame:
    """A corpus of any number of articles as documents of at most so many each, in the order that one document has.

    Each has the heading of the whole corpus, and `first`: the place of its first article. No articles are one document.
    """
    order = [F.desc_nulls_last("date"), F.asc_nulls_last("id")]
    numbered = running_number(articles.select(*COLUMNS), order, "__n")
    first = F.floor((F.col("__n") - 1) / per_document) * per_document
    listed = numbered.groupBy(first.cast("long").alias("first")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("__n", F.struct(*COLUMNS).alias("a")))), lambda x: x["a"]).alias("articles")
    )
    start = articles.sparkSession.range(1).select(F.col("id").alias("first"))
    every = listed.join(start, "first", "full").withColumn("articles", F.coalesce("articles", F.array().cast(listed.schema["articles"].dataType)))
    head = heading(stats, generated_at, sources_ok, sources_failed, official_results, cleaned)
    return every.join(F.broadcast(head)).select(
        "generated_at", "sources_ok", "sources_failed", "official_results", "cleaned_noise", "articles", "stats", "first"
    )


def write_articles(articles: DataFrame, path: str) -> None:
    """Articles as JSON lines, a file a task: the form for corpora too large for one document."""
    articles.select(*COLUMNS).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_document(document: DataFrame, path: str) -> None:
    """Documents as JSON text, one a line, in the folder path, nulls kept; a single one is one file."""
    document.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def file_system(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


class Conflict(Exception):
    """Another job has committed the version that this one wanted to."""


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Create a small file with this text, whole or not at all; False if there is one already.

    Local files are linked and those of HDFS renamed into place, which fails where a file is. Object stores show an object
    when it is whole; theirs are created on the condition that none is there, which the store must support.
    """
    target, store = file_system(spark, path)
    scheme = store.getUri().getScheme()
    if scheme not in ("file", "hdfs", "viewfs"):
        try:
            written(store.create(target, False), text)
            return True
        except Py4JJavaError:
            if store.exists(target):
                return False
            raise
    store.mkdirs(target.getParent())
    whole, _ = file_system(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    written(store.create(whole, False), text)
    try:
        if scheme != "file":
            return store.rename(whole, target)
        jvm = spark.sparkContext._jvm
        local = lambda p: jvm.java.nio.file.Path.of(p.toUri().getPath(), spark.sparkContext._gateway.new_array(jvm.java.lang.String, 0))
        jvm.java.nio.file.Files.createLink(local(target), local(whole))
        return True
    except Py4JJavaError:
        if store.exists(target):
            return False
        raise
    finally:
        store.delete(whole, False)


def written(out, text: str) -> None:
    out.write(bytearray(text.encode()))
    out.close()


def read_small(spark: SparkSession, path: str) -> str:
    target, store = file_system(spark, path)
    found = store.open(target)
    try:
        return bytes(found.readAllBytes()).decode()
    finally:
        found.close()


def numbers(spark: SparkSession, folder: str) -> list[int]:
    """Numbers that files of this folder are named by, least first."""
    target, store = file_system(spark, folder)
    names = [s.getPath().getName() for s in store.listStatus(target)] if store.exists(target) else []
    return sorted(int(n) for n in names if n.isdigit())


def commit_path(path: str, number: int) -> str:
    return f"{path}/_versions/{number:012d}"


def commit_of(spark: SparkSession, path: str, number: int) -> dict:
    """What a commit says: folder, and the last batch of each stream that the version holds."""
    return json.loads(read_small(spark, commit_path(path, number)))


def versions(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """(number, folder) of the table's versions whose rows are still there, oldest first."""
    out = []
    for number in numbers(spark, f"{path}/_versions"):
        folder = commit_of(spark, path, number)["folder"]
        target, store = file_system(spark, f"{path}/{folder}")
        if store.exists(target):
            out.append((number, folder))
    return out


def commit_version(spark: SparkSession, path: str, number: int, folder: str, batches: dict[str, int]) -> bool:
    return create_once(spark, commit_path(path, number), json.dumps({"folder": folder, "batches": batches}))


def write_version(rows: DataFrame, path: str, base: int | None, batches: dict[str, int], keep: int) -> int:
    """Write rows as the version after base; Conflict if another job has made that one meanwhile."""
    spark = rows.sparkSession
    folder, number = f"data-{uuid.uuid4().hex}", 0 if base is None else base + 1
    rows.write.parquet(f"{path}/{folder}")
    if not commit_version(spark, path, number, folder, batches):
        target, store = file_system(spark, f"{path}/{folder}")
        store.delete(target, True)
        raise Conflict(f"{path} has a version {number} already")
    # Commits stay, so that no number is ever free again; the rows of old versions go.
    for old in range(max(0, number - 2 * keep), number + 1 - keep):
        target, store = file_system(spark, commit_path(path, old))
        if store.exists(target):
            target, store = file_system(spark, f"{path}/{commit_of(spark, path, old)['folder']}")
            store.delete(target, True)
    return number


def update_table(
    spark: SparkSession,
    path: str,
    change: Callable[[DataFrame], DataFrame],
    batch: tuple[str, int] | None = None,
    tries: int = 10,
    keep: int = 2,
    schema: str = ARTICLE,
) -> int | None:
    """Replace the table's rows by change(rows) as one step, whatever other jobs do; the version's number.

    change is asked again, with the winner's rows, if another job was faster; after so many tries Conflict rises. batch: name
    of a stream and number of its batch, kept with the version: a batch that the table holds already changes nothing (None).
    """
    for left in reversed(range(tries)):
        found = numbers(spark, f"{path}/_versions")
        base = found[-1] if found else None
        held = commit_of(spark, path, base)["batches"] if found else {}
        if batch and held.get(batch[0], -1) >= batch[1]:
            return None
        try:
            return write_version(change(read_version(spark, path, base, schema)), path, base, held | dict([batch] if batch else []), keep)
        except Conflict:
            if not left:
                raise
    raise ValueError("tries must be positive")


def replace_table(rows: DataFrame, path: str, keep: int = 2) -> int:
    """Write rows as a new version of the table, whatever rows it had. Readers see the old rows or the new ones.

    The rows of the last `keep` versions stay, for readers that have begun with an older one. Rows that were made from the
    table's own belong in `update_table`, which loses nobody's.
    """
    return update_table(rows.sparkSession, path, lambda _: rows, keep=keep)


def read_version(spark: SparkSession, path: str, number: int | None, schema: str = ARTICLE) -> DataFrame:
    if number is None:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/{commit_of(spark, path, number)['folder']}")


def read_table(spark: SparkSession, path: str, schema: str = ARTICLE) -> DataFrame:
    """The inventory, or another table of versions; no rows before it is first written. A folder with data but no version in force is an error."""
    found = numbers(spark, f"{path}/_versions")
    target, store = file_system(spark, f"{path}/_versions")
    if not found and store.exists(target):
        raise OSError(f"{path} has lost its versions")
    return read_version(spark, path, found[-1] if found else None, schema)


def take_lock(spark: SparkSession, path: str, now_ms: int, stale_ms: int = 7_200_000) -> str | None:
    """The owner's token of a lease that is taken, or None if another's is in force.

    Leases are numbered, in the folder path. The last one is in force until it is released or stale_ms old; whoever finds it
    over creates the next number, which one job alone can do. A lease that is in force is never moved or deleted, so that a
    job that looked before it was taken can't push it out.
    """
    found = numbers(spark, path)
    last = found[-1] if found else -1
    if found:
        over, store = file_system(spark, f"{path}/{last:012d}.released")
        taken = json.loads(read_small(spark, f"{path}/{last:012d}"))["taken_ms"]
        if not store.exists(over) and now_ms - taken < stale_ms:
            return None
    token = f"{last + 1}-{uuid.uuid4().hex}"
    return token if create_once(spark, f"{path}/{last + 1:012d}", json.dumps({"token": token, "taken_ms": now_ms})) else None


def release_lock(spark: SparkSession, path: str, token: str) -> bool:
    """End this owner's lease; False if it isn't the last one, or has ended."""
    found = numbers(spark, path)
    if not found or json.loads(read_small(spark, f"{path}/{found[-1]:012d}"))["token"] != token:
        return False
    return create_once(spark, f"{path}/{found[-1]:012d}.released", token)


def append_run(spark: SparkSession, path: str, run_date: str, added: int, total: int, failed: list[str], most: int = 50) -> None:
    """Append a run's figures and its first failed sources to the log table."""
    row = [(run_date, added, total, len(failed), failed[:most])]
    schema = "run_date string, added long, total long, n_failed long, failed array<string>"
    spark.createDataFrame(row, schema).coalesce(1).write.mode("append").parquet(path)
