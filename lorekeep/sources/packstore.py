"""Packs on disk: builds that are staged, proved and only then published, and a data source that mounts them.

A store is a folder:

- `builds/<build>/docs` and `.../chunks`: the rows of one build, by pack.
- `catalog`: one row a pack, written last, by dynamic overwrite of that pack's partition: which build holds it, its counts, its content hash, and what a reader checks before it loads the pack.

A build writes its rows, reads them back, recomputes every chunk's hash from what was read and compares number and sum of hashes with those counted while writing. Whatever fails before the catalog is written removes
the build's folder, and readers go on with the builds before it. Readers ask the catalog, so a half-written build is never seen.

`spark.read.format("pack")` plans a partition for each file of the packs asked for: filters on pack_id choose packs in the catalog, ranges of doc_id and chunk_id skip row groups by their statistics."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from lorekeep.operators import packs as P
from lorekeep.sources import text as TX
from lorekeep.storage import folder, remove

DOCS = "pack_id string, doc_id long, title string, slug string"
CHUNKS = "pack_id string, doc_id long, chunk_id long, section_path string, locator string, text string, content_sha string"
SCHEMAS = {"docs": DOCS, "chunks": CHUNKS}
CATALOG = "build string, docs long, chunks long, content_sha256 string, embedder_sha256 string, schema_version long, vec_format_version string, pack_id string"


class BuildError(ValueError):
    """A build that was not published."""


class PackStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        spark.dataSource.register(PackSource)
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")

    def catalog(self) -> DataFrame:
        """One row for each published pack; none before the first build."""
        target = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/catalog")
        if not target.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(target):
            return self.spark.createDataFrame([], CATALOG)
        return self.spark.read.schema(CATALOG).parquet(f"{self.path}/catalog")

    def build(self, docs: DataFrame, chunks: DataFrame, manifests: DataFrame) -> DataFrame:
        """Publishes the packs that occur in docs: pack_id, docs, chunks, content_sha256, as read back.

        docs: pack_id, doc_id, title, slug; chunks: doc_id, chunk_id, section_path, locator, text; manifests: pack_id, key, value. What a pack must not hold (see build_problems), a manifest that doesn't load, a pack without a
        manifest and rows that differ when read back are errors."""
        docs = docs.select(F.col("pack_id").cast("string").alias("pack_id"), "doc_id", "title", "slug")
        problems = P.build_problems(docs, chunks).unionByName(docs.where("pack_id is null").select("doc_id", F.lit("no pack").alias("problem")))
        bad = problems.orderBy("doc_id").first()
        if bad:
            raise BuildError(f"document {bad['doc_id']}: {bad['problem']}")
        typed = P.typed_manifests(manifests.withColumn("pack_id", F.col("pack_id").cast("string")))
        checks = P.load_checks(typed.withColumn("dims", F.col("embedding_dims").try_cast("long")).withColumn("has_titles", F.lit(True)), [], need_embedder=False)
        wrong = docs.select(F.col("pack_id").alias("pack")).distinct().join(checks.withColumn("known", F.lit(True)), "pack", "left").where("known is null or problem is not null").orderBy("pack").first()
        if wrong:
            raise BuildError(f"pack {wrong['pack']}: {wrong['problem'] or 'no manifest'}")

        build = uuid.uuid4().hex
        root = f"{self.path}/builds/{build}"
        try:
            # rebalanced, small packs are one file and a large one is split, however skewed they are
            docs.hint("rebalance", "pack_id").write.partitionBy("pack_id").parquet(f"{root}/docs")
            sent = Observation()
            hashed = P.chunk_shas(chunks, docs).join(docs.select("doc_id", "pack_id"), "doc_id").select("pack_id", "doc_id", "chunk_id", "section_path", "locator", "text", "content_sha")
            hashed = hashed.observe(sent, F.count("*").alias("n"), F.sum(F.xxhash64("chunk_id", "content_sha").cast("decimal(38,0)")).alias("sum"))
            hashed.hint("rebalance", "pack_id").write.partitionBy("pack_id").parquet(f"{root}/chunks")
            got = {name: self.spark.read.schema(schema).parquet(f"{root}/{name}") for name, schema in SCHEMAS.items()}
            again = P.chunk_shas(got["chunks"].drop("content_sha"), got["docs"])
            back = again.agg(F.count("*").alias("n"), F.sum(F.xxhash64("chunk_id", "content_sha").cast("decimal(38,0)")).alias("sum")).first()
            if (back["n"], back["sum"]) != (sent.get["n"], sent.get["sum"]):
                raise BuildError("the rows read back are not those written")
            shas = P.pack_shas(again, "pack_id")
            counts = got["docs"].groupBy("pack_id").agg(F.count("*").alias("docs"))
            rows = counts.join(shas, "pack_id").join(typed.select(F.col("pack").alias("pack_id"), "embedder_sha256", F.col("schema_version").try_cast("long").alias("schema_version"), "vec_format_version"), "pack_id")
            rows = rows.select(F.lit(build).alias("build"), "docs", "chunks", "content_sha256", "embedder_sha256", "schema_version", "vec_format_version", "pack_id")
            rows.hint("rebalance").write.partitionBy("pack_id").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(f"{self.path}/catalog")
        except Exception:
            remove(self.spark, root)
            raise
        return self.catalog().where(F.col("build") == build).select("pack_id", "docs", "chunks", "content_sha256")

    def upsert(self, docs: DataFrame, chunks: DataFrame, manifests: DataFrame) -> DataFrame:
        """Builds the packs of docs anew from what they hold and the rows given: a document given replaces the one with its id, and all its chunks."""
        touched = docs.select(F.col("pack_id").cast("string").alias("pack_id")).distinct()
        old = {name: self.read(name).join(touched, "pack_id", "left_semi") for name in SCHEMAS}
        new = docs.select(F.col("pack_id").cast("string").alias("pack_id"), "doc_id", "title", "slug")
        kept = old["chunks"].join(new.select("doc_id"), "doc_id", "left_anti").select("doc_id", "chunk_id", "section_path", "locator", "text")
        return self.build(TX.upsert(old["docs"], new, ["pack_id", "doc_id"]), kept.unionByName(chunks.select(kept.columns)), manifests)

    def read(self, table: str = "chunks", embedders: list[str] | None = None, skip: bool = False) -> DataFrame:
        """The rows of all published packs. With embedders, packs made with another are refused: an error, or left out with skip."""
        r = self.spark.read.format("pack").option("table", table).option("skip", str(skip).lower())
        return (r.option("embedders", ",".join(embedders)) if embedders else r).load(self.path)

    def vacuum(self) -> int:
        """Removes builds that no pack uses any more; their number."""
        used = {r["build"] for r in self.catalog().select("build").distinct().collect()}
        fs, root = folder(f"{self.path}/builds")
        old = [f.base_name for f in fs.get_file_info(pafs.FileSelector(root)) if f.base_name not in used]
        for name in old:
            remove(self.spark, f"{self.path}/builds/{name}")
        return len(old)


@dataclass
class PackFile(InputPartition):
    pack_id: str
    name: str


class PackReader(DataSourceReader):
    IDS = ("doc_id", "chunk_id")

    def __init__(self, options: dict):
        self.path, self.table, self.skip = options["path"], options.get("table", "chunks"), options.get("skip") == "true"
        self.embedders = {e.lower() for e in options["embedders"].split(",")} if options.get("embedders") else None
        self.packs: set[str] | None = None
        self.bounds: list[tuple[str, str, int]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Packs are chosen exactly; bounds of ids skip row groups, and Spark still compares each row."""
        signs = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
        for f in filters:
            column = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if column == "pack_id" and isinstance(f, EqualTo | In):
                asked = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.packs = asked if self.packs is None else self.packs & asked
                continue
            if column in self.IDS and type(f) in signs:
                self.bounds.append((column, signs[type(f)], f.value))
            yield f

    def partitions(self) -> list[PackFile]:
        fs, root = folder(self.path)
        if fs.get_file_info(f"{root}/catalog").type == pafs.FileType.NotFound:
            return []
        kinds = pa.schema([("build", pa.string()), ("embedder_sha256", pa.string()), ("schema_version", pa.int64()), ("vec_format_version", pa.string()), ("pack_id", pa.string())])
        rows = ds.dataset(f"{root}/catalog", schema=kinds, filesystem=fs, partitioning=ds.partitioning(pa.schema([("pack_id", pa.string())]), flavor="hive")).to_table().to_pylist()
        out = []
        for r in sorted(rows, key=lambda r: r["pack_id"]):
            if self.packs is not None and r["pack_id"] not in self.packs:
                continue
            odd = not P.OLDEST <= r["schema_version"] <= P.NEWEST or r["vec_format_version"] != P.VECTOR_FORMAT or (self.embedders is not None and r["embedder_sha256"].lower() not in self.embedders)
            if odd and self.skip:
                continue
            if odd:
                raise ValueError(f"pack {r['pack_id']} does not load: another embedder or format")
            where = f"{root}/builds/{r['build']}/{self.table}/pack_id={hive(r['pack_id'])}"
            out += [PackFile(r["pack_id"], f.path) for f in fs.get_file_info(pafs.FileSelector(where, allow_not_found=True)) if f.path.endswith(".parquet")]
        return out

    def wanted(self, group: pq.RowGroupMetaData) -> bool:
        """Whether a row group's statistics leave room for the bounds."""
        spans = {c.path_in_schema: c.statistics for c in (group.column(i) for i in range(group.num_columns))}
        for column, sign, value in self.bounds:
            s = spans.get(column)
            if s is None or not s.has_min_max:
                continue
            if (sign in ("=", ">=") and s.max < value) or (sign == ">" and s.max <= value) or (sign in ("=", "<=") and s.min > value) or (sign == "<" and s.min >= value):
                return False
        return True

    def read(self, partition: PackFile | None) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        fs, _ = folder(self.path)
        names = [c.split()[0] for c in SCHEMAS[self.table].split(", ")]
        with fs.open_input_file(partition.name) as f:
            file = pq.ParquetFile(f)
            groups = [i for i in range(file.num_row_groups) if self.wanted(file.metadata.row_group(i))]
            for batch in file.iter_batches(batch_size=4096, row_groups=groups):
                own = pa.array([partition.pack_id] * batch.num_rows, pa.string())
                yield pa.RecordBatch.from_arrays([own if n == "pack_id" else batch.column(n) for n in names], names)


class PackSource(DataSource):
    """Options: table (docs or chunks), embedders (hashes, comma-joined), skip ("true": leave out packs that don't load)."""

    @classmethod
    def name(cls) -> str:
        return "pack"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("table", "chunks")]

    def reader(self, schema) -> PackReader:
        return PackReader(self.options)


def hive(value: str) -> str:
    """A partition value as Spark names its folder."""
    return "".join(quote(c, safe="") if c in "\"#%'*/:=?\\{}[]^\x7f" or c < " " else c for c in value) or "__HIVE_DEFAULT_PARTITION__"
