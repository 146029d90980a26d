"""The stored library of sentences: documents are added in batches, and a check reads only what its sentences need.

Below the store's root: ``docs`` (doc_id, sha256, name, n_chars, n_sentences), ``sentences`` in folders by slot of the
normal form's hash, ``blocks`` in folders by block number and range of block values. Each batch has its own folders, and a
commit is one small new file that lists the batches in force, so readers see a batch whole or not at all, and what a failed
addition left behind is never read.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fingerprint as fp
from ..sources.folders import Folders, work_dir
from . import library, overlap, segment

SLOTS = 64
RANGE_BITS = 6
#: Rows that a file of blocks or sentences is meant for.
FILE_ROWS = 4_000_000
_DOCS = "doc_id long, sha256 string, name string, n_chars long, n_sentences long"
_SENTENCES = "doc_id long, idx int, display string, norm string, start int, end int, fp long, norm_id long"
_BLOCKS = "value int, fp long, norm_id long"


def _range(value: Column) -> Column:
    return F.shiftright(value, fp.BLOCK_BITS - RANGE_BITS)


def _norm_id(norm: Column) -> Column:
    return F.xxhash64(norm)


class SentenceStore:
    """A library below ``root``, any folder that the driver and all executors see. One writer at a time; readers hold
    what was in force when they asked."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root, self.folders = spark, root.rstrip("/"), Folders(spark)

    # ---- what is in force ----

    def _commits(self) -> list[int]:
        return sorted(int(x) for x in self.folders.names(f"{self.root}/commits") if x.isdigit())

    def batches(self) -> list[int]:
        """The batches in force, by the last whole commit."""
        for n in reversed(self._commits()):
            words = self.folders.read(f"{self.root}/commits/{n}").split()
            if words[-1:] == ["end"]:
                return [int(x) for x in words[:-1]]
        return []

    def _commit(self, batches: list[int]) -> None:
        n = (self._commits() or [-1])[-1] + 1
        if not self.folders.create(f"{self.root}/commits/{n}", " ".join([*map(str, batches), "end"])):
            raise RuntimeError("another writer committed meanwhile")

    def _next(self) -> int:
        seen = [int(x.removeprefix("batch=")) for x in self.folders.names(f"{self.root}/docs") if x.startswith("batch=")]
        return max([*self.batches(), *seen, -1]) + 1

    def _table(self, name: str, schema: str, folders: str = "") -> DataFrame:
        own = self.batches()
        if not own:
            return self.spark.createDataFrame([], f"{schema}{folders}")
        return self.spark.read.schema(f"{schema}, batch int{folders}").parquet(f"{self.root}/{name}").where(F.col("batch").isin(own)).drop("batch")

    def docs(self) -> DataFrame:
        return self._table("docs", _DOCS)

    def names(self) -> DataFrame:
        return self.docs().select("doc_id", "name")

    def sentences(self) -> DataFrame:
        """All sentences with their fingerprints, as they were stored."""
        return self._table("sentences", _SENTENCES, ", slot int").drop("slot")

    def stats(self) -> DataFrame:
        """One row: documents, n_chars, sentences; of the documents' table alone."""
        zero = F.lit(0).cast("long")
        return self.docs().agg(F.count("*").alias("documents"), *(F.coalesce(F.sum(c), zero).alias(n) for c, n in (("n_chars", "n_chars"), ("n_sentences", "sentences"))))

    def params_key(self, fallback: bool = True) -> str:
        return self.stats().select(library.params_key(F.lit(fallback), F.col("documents"), F.col("n_chars"), F.col("sentences")).alias("k")).first()["k"]

    def source_text(self, doc_ids: list[int]) -> DataFrame:
        return library.source_text(self.sentences().where(F.col("doc_id").isin(doc_ids)))

    # ---- writing ----

    def append(self, files: DataFrame) -> int:
        """Add the documents of ``files`` (name, text) whose content the library lacks; of one content the first name
        counts. A null text is an empty one. Returns how many are new; then one batch more is in force."""
        known = self.docs()
        own = library.with_sha(files.select("name", F.coalesce("text", F.lit("")).alias("text")))
        new = library.new_documents(own, known, order_col="name")
        n = self._next()
        staged = f"{self.root}/staged/batch={n}"
        library.numbered(new, known, order_col="name").select("doc_id", "sha256", "name", "text").write.mode("overwrite").parquet(staged)
        docs = self.spark.read.parquet(staged)
        count = docs.count()
        if count:
            self._write_sentences(library.library_sentences(docs), n)
            sents = self.spark.read.schema(f"{_SENTENCES}, slot int").parquet(f"{self.root}/sentences/batch={n}")
            self._write_blocks(sents, n)
            sizes = segment.body_chars(sents)
            rows = docs.join(sizes, "doc_id", "left").select("doc_id", "sha256", "name", F.coalesce("body_chars", F.lit(0)).cast("long").alias("n_chars"), F.coalesce("n_sentences", F.lit(0)).cast("long").alias("n_sentences"))
            rows.write.mode("overwrite").parquet(f"{self.root}/docs/batch={n}")
            self._commit([*self.batches(), n])
        self.folders.delete(staged)
        return count

    def _write_sentences(self, sents: DataFrame, n: int) -> None:
        x = sents.withColumn("norm_id", _norm_id(F.col("norm"))).withColumn("slot", F.pmod("norm_id", F.lit(SLOTS)).cast("int"))
        x = x.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(self._parts())))
        x = x.repartition("slot", "part").sortWithinPartitions("slot", "norm_id").select(*[c.split()[0] for c in _SENTENCES.split(", ")], "slot")
        x.write.mode("overwrite").partitionBy("slot").option("maxRecordsPerFile", FILE_ROWS).parquet(f"{self.root}/sentences/batch={n}")

    def _parts(self) -> int:
        """Tasks that share a slot, so that a slot of a large batch is no single task."""
        return max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")) // SLOTS)

    def _write_blocks(self, sents: DataFrame, n: int) -> None:
        x = sents.where("fp <> 0").select("fp", "norm_id").distinct()
        x = x.select("fp", "norm_id", F.posexplode(fp.blocks(F.col("fp"))).alias("block", "value")).withColumn("range", _range(F.col("value")))
        x = x.withColumn("part", F.pmod("norm_id", F.lit(self._parts())))
        x = x.repartition("block", "range", "part").sortWithinPartitions("block", "range", "value").select("value", "fp", "norm_id", "block", "range")
        x.write.mode("overwrite").partitionBy("block", "range").option("maxRecordsPerFile", FILE_ROWS).parquet(f"{self.root}/blocks/batch={n}")

    def compact(self) -> None:
        """Put all batches in force together in a new one; then :meth:`vacuum` may delete the old ones."""
        n = self._next()
        if len(self.batches()) < 2:
            return
        self._write_sentences(self.sentences(), n)
        self._write_blocks(self.sentences(), n)
        self.docs().write.mode("overwrite").parquet(f"{self.root}/docs/batch={n}")
        self._commit([n])

    def vacuum(self) -> None:
        """Delete batches and commits that are not in force, once no reader holds them."""
        own, commits = self.batches(), self._commits()
        for table in ("docs", "sentences", "blocks", "staged"):
            for x in self.folders.names(f"{self.root}/{table}"):
                if x.startswith("batch=") and int(x.removeprefix("batch=")) not in own:
                    self.folders.delete(f"{self.root}/{table}/{x}")
        for c in commits[:-1]:
            self.folders.delete(f"{self.root}/commits/{c}")

    # ---- checking ----

    def candidates(self, query: DataFrame) -> DataFrame:
        """As :func:`overlap.candidates`, with norm_id in place of norm, by the stored blocks: q_norm, norm_id, distance,
        min_block. Only the folders of (block, range of values) that the query's sentences have are read."""
        return self._sharing(query).dropDuplicates(["q_norm", "norm_id"])  # a normal form may be in several batches

    def _sharing(self, query: DataFrame) -> DataFrame:
        q = query.where("fp <> 0").select(F.col("norm").alias("q_norm"), F.col("fp").alias("q_fp")).distinct()
        q = q.select("*", F.posexplode(fp.blocks(F.col("q_fp"))).alias("block", "value")).withColumn("range", _range(F.col("value")))
        needed: dict[int, list[int]] = {}
        for r in q.select("block", "range").distinct().collect():  # blocks times ranges at most
            needed.setdefault(r["block"], []).append(r["range"])
        own = F.lit(False)
        for block, ranges in sorted(needed.items()):
            own = own | ((F.col("block") == block) & F.col("range").isin(sorted(ranges)))
        stored = self._table("blocks", _BLOCKS, ", block int, range int").where(own)
        return overlap.sharing(q, stored.withColumnRenamed("fp", "l_fp"), "norm_id", ["block", "range", "value"])

    def literal_matches(self, query: DataFrame) -> DataFrame:
        """As :func:`overlap.literal_matches` against the store. Candidates are held until they met the sentences, of
        which only their slots are read. Of a query side that is broadcast only the forms that it may match are held, not
        the pairs."""
        if overlap.few(query):
            wanted = self._sharing(query).select("norm_id").distinct().withColumn("slot", F.pmod("norm_id", F.lit(SLOTS)).cast("int")).persist(StorageLevel.DISK_ONLY)
            return overlap.literal_matches(query, self._sentences_of(wanted), stored=True)
        pairs = self.candidates(query).withColumn("slot", F.pmod("norm_id", F.lit(SLOTS)).cast("int")).persist(StorageLevel.DISK_ONLY)
        sents = self._sentences_of(pairs.select("norm_id", "slot").distinct())
        named = pairs.join(sents.select("slot", "norm_id", "norm").distinct(), ["slot", "norm_id"]).select("q_norm", "norm", "distance", "min_block")
        return overlap.placed(overlap.verified(named), query, sents)

    def _sentences_of(self, wanted: DataFrame) -> DataFrame:
        """The stored sentences of some normal forms (norm_id, slot); only their slots are read."""
        slots = sorted(r["slot"] for r in wanted.select("slot").distinct().collect())  # SLOTS at most
        return self._table("sentences", _SENTENCES, ", slot int").where(F.col("slot").isin(slots)).join(wanted, ["slot", "norm_id"], "left_semi")

    def all_matches(self, query: DataFrame, *, fallback: bool = True, vectors: DataFrame | None = None) -> DataFrame:
        """Literal matches and the fallback's. The fallback compares with every stored normal form; nothing is segmented
        or hashed again."""
        literal = self.literal_matches(query)
        if not fallback:
            return literal
        return literal.unionByName(overlap.fallback_matches(overlap.pending(query, literal), self.sentences(), vectors))


def temporary(spark: SparkSession) -> SentenceStore:
    """An empty store in the session's shared folder."""
    return SentenceStore(spark, work_dir(spark, "store"))
