"""An inverted index that is kept: chapters whose text changed are indexed anew, questions read only what they ask for.

On disk it is two logs by batch. `chapters` has a row for each (book, ch) that a batch changed: its text's
SHA-1, its size in words, its version; a removed chapter has no digest. `postings` has rows of a word and many
such chapters, with its places in each, in folders by the word's first two letters, so that the begin of a word names
the folders that can hold it. Rows of one chapter each would weigh several times as much where they are sorted. The newest batch of a chapter is the one that counts: older postings of it are
dead, and go when the index is compacted. A batch writes its postings first and its chapters last; what has no
chapters yet doesn't count, and a batch that is run again after a failure takes the place of what it had left.

Defined results: of rows of one (book, ch) in a batch the highest version counts, ties to the greater text; a version older
than the kept one is ignored, an unchanged text leaves the kept version; a null text removes the chapter, if it is there; a text without words is a chapter of size 0;
rows with a null book or ch are left out; further columns don't matter; a question without words finds
nothing; an index without chapters answers with no rows.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import fold_for_search, plain_words
from ..session import small_batches
from .links import written
from .search import B, K1, indexed_words, parsed

#: Folders by a word's first and second letter.
FIRST, SECOND = 16, 8
_CHAPTERS = "book string, ch long, version long, digest string, size int, batch long"
#: A word's chapters, its hits in each, where these begin in its places, and its places from 1, chapter by chapter.
_BLOCK = "token string, books array<string>, chs array<long>, tfs array<int>, begins array<int>, places array<int>"
_POSTINGS = f"{_BLOCK}, batch long, first int, second int"
#: Words of the chapters that a worker takes at once, and words that a task sorts, about.
AT_ONCE, SORTED = 1_000_000, 500_000


def _folder_of(letter: Column, folders: int) -> Column:
    return F.pmod(F.crc32(letter.cast("binary")), F.lit(folders)).cast("int")


def _letters(token: Column) -> tuple[Column, Column]:
    return _folder_of(F.substring(token, 1, 1), FIRST), _folder_of(F.substring(token, 2, 1), SECOND)


def _shifted(places: str, by: int) -> Column:
    return F.transform(places, lambda p: p - by)


def _block_rows(book: pa.Array, ch: pa.Array, words: pa.Array) -> pa.RecordBatch:
    """_BLOCK of some chapters, a row a word."""
    coded = pc.dictionary_encode(words.flatten())
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    key = codes * len(words) + np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + 1
    order = np.argsort(key, kind="stable")  # a word's places stay in order
    key = key[order]
    begins = np.flatnonzero(np.diff(key, prepend=-1))
    token, row = np.divmod(key[begins], len(words))
    tops = np.flatnonzero(np.diff(token, prepend=-1))  # where a word's chapters begin
    per_word = np.append(tops, len(begins)).astype(np.int32)
    in_block = begins - np.repeat(begins[tops], np.diff(per_word))
    lists = [book.take(pa.array(row)), ch.take(pa.array(row)), pa.array(np.diff(np.append(begins, len(key))).astype(np.int32)), pa.array(in_block.astype(np.int32))]
    per_place = np.append(begins[tops], len(key)).astype(np.int32)
    cols = [coded.dictionary.take(pa.array(token[tops])), *(pa.ListArray.from_arrays(pa.array(per_word), x) for x in lists), pa.ListArray.from_arrays(pa.array(per_place), pa.array(place[order].astype(np.int32)))]
    return pa.RecordBatch.from_arrays(cols, names=["token", "books", "chs", "tfs", "begins", "places"])


def blocks(batches):
    """_BLOCK of Arrow batches of book, ch, words; a block is of AT_ONCE words or the chapter that fills it."""
    held, words = [], 0
    for batch in batches:
        size = pc.list_value_length(batch.column("words")).to_numpy(zero_copy_only=False).astype(np.int64)
        cuts = np.flatnonzero(np.diff((words + np.cumsum(size)) // AT_ONCE, prepend=0))  # a piece ends with the chapter that fills it
        for a, b in zip(np.append(0, cuts + 1), np.append(cuts + 1, len(size)), strict=True):
            held.append(batch.slice(a, b - a))
            words += int(size[a:b].sum())
            if words >= AT_ONCE:
                yield _block_rows(*(pa.concat_arrays([x.column(c) for x in held]) for c in ("book", "ch", "words")))
                held, words = [], 0
    if held:
        yield _block_rows(*(pa.concat_arrays([x.column(c) for x in held]) for c in ("book", "ch", "words")))


def inverted(rows: DataFrame) -> DataFrame:
    """_BLOCK of rows of book, ch, words array<string>; no shuffle. A word comes again for every AT_ONCE words of its chapters."""
    small_batches(rows.sparkSession)
    return rows.select("book", "ch", "words").mapInArrow(blocks, _BLOCK)


def _chapter_rows(blocks: DataFrame, places: bool) -> DataFrame:
    """token, book, ch, tf, perhaps places, and the folders and batch, of rows of _BLOCK."""
    each = F.transform(F.arrays_zip("books", "chs", "tfs", "begins"), lambda x: F.struct(x["books"].alias("book"), x["chs"].alias("ch"), x["tfs"].alias("tf"), *([F.slice("places", x["begins"] + 1, x["tfs"]).alias("places")] if places else [])))
    return blocks.select("token", "batch", "first", "second", F.explode(each).alias("r")).select("token", "batch", "first", "second", "r.*")


def to_feed(chapters: DataFrame, folder: str, per_file: int = 100) -> None:
    """Appends chapters (book, ch, version, text) to a folder that a stream reads, at most per_file of a book in a file; a long book is dealt over tasks, and no text is sorted."""
    chapters.repartition("book", F.floor(F.col("ch") / per_file)).write.mode("append").option("maxRecordsPerFile", per_file).parquet(folder)


class KeptIndex:
    """The index in a folder that the driver and all executors share."""

    def __init__(self, spark: SparkSession, path: str, salts: int = 8):
        self.spark, self.path, self.salts = spark, path.rstrip("/"), salts

    # ---- writing

    def put(self, chapters: DataFrame, batch: int | None = None) -> int:
        """Brings chapters (book, ch, version, text) into the index; the number of those whose text was new. Batches come in ascending order."""
        log = self._log()
        number = batch if batch is not None else 1 + (log.agg(F.max("batch")).first()[0] or 0)
        have = self._newest(log.filter(F.col("batch") < number)).select("book", "ch", F.col("version").alias("had"), F.col("digest").alias("kept"))
        rows = chapters.filter("book IS NOT NULL AND ch IS NOT NULL").select(F.col("book").cast("string").alias("book"), F.col("ch").cast("long").alias("ch"), F.coalesce(F.col("version").cast("long"), F.lit(0)).alias("version"), "text")
        newest = rows.groupBy("book", "ch").agg(F.max(F.struct("version", F.col("text").isNotNull().alias("there"), "text")).alias("r")).select("book", "ch", "r.version", "r.text")
        met = newest.withColumn("digest", F.sha1(F.col("text").cast("binary"))).join(have, ["book", "ch"], "left")
        fresh = met.filter(~F.col("digest").eqNullSafe(F.col("kept")) & F.coalesce(F.col("version") >= F.col("had"), F.lit(True)))
        changed = written(fresh.select("book", "ch", "version", "digest", F.when(F.col("text").isNotNull(), indexed_words(F.col("text"))).alias("words")))
        n, words = changed.agg(F.count("*"), F.coalesce(F.sum(F.greatest(F.size("words"), F.lit(0)).cast("long")), F.lit(0))).first()
        if n:
            first, second = _letters(F.col("token"))
            self._post(inverted(changed.filter("words IS NOT NULL")).withColumns({"first": first, "second": second}), words, number)
            changed.select("book", "ch", "version", "digest", F.size("words").alias("size")).write.mode("overwrite").parquet(f"{self.path}/chapters/batch={number}")
        return n

    def feed(self, folder: str, checkpoint: str, files: int = 64) -> None:
        """Indexes what a feed folder holds and hasn't been indexed, some files a batch, and ends; from its checkpoint it goes on after a failure."""
        stream = self.spark.readStream.schema("book string, ch long, version long, text string").option("maxFilesPerTrigger", files).parquet(folder)
        stream.writeStream.foreachBatch(lambda rows, number: self.put(rows, number) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

    def compact(self) -> None:
        """Writes what counts as one new batch and deletes all older ones."""
        log = written(self._log())
        live = self._newest(log).filter("digest IS NOT NULL")
        last = log.agg(F.max("batch")).first()[0]
        if last is None:
            return
        kept = _chapter_rows(self._postings(), True).join(live.select("book", "ch", "batch"), ["book", "ch", "batch"], "left_semi").drop("batch")
        one = {**{name: F.array(of) for name, of in (("books", "book"), ("chs", "ch"), ("tfs", "tf"))}, "begins": F.array(F.lit(0))}
        self._post(kept.withColumns(one).drop("book", "ch", "tf"), live.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0], last + 1)
        live.drop("batch").write.mode("overwrite").parquet(f"{self.path}/chapters/batch={last + 1}")
        for r in log.select("batch").distinct().collect():  # a number a batch
            for kind in ("postings", "chapters"):
                self._delete(f"{self.path}/{kind}/batch={r['batch']}")

    # ---- reading

    def chapters(self) -> DataFrame:
        """book, ch, version, digest, size, batch of the chapters that are there."""
        return self._newest(self._log()).filter("digest IS NOT NULL")

    def hits(self, question: str, every: bool = True, guard: Column | None = None) -> DataFrame:
        """book, ch, size and h0, h1 ... (hits of each part of the question) of the chapters that have all parts, or any."""
        found = self._hits([self._folded(p) for p in parsed(question)], guard)
        return found if found is None or not every else found.filter(functools.reduce(lambda a, b: a & b, (F.col(c) > 0 for c in found.columns if c[0] == "h")))

    def ranked(self, prefixes: list[str], k: int, every: bool = True, guard: Column | None = None) -> DataFrame:
        """book, ch, score: BM25 of the k best chapters that have a word with each begin, or any. Ties to the smaller ch."""
        found = written(self._hits([["^", p] for p in prefixes], guard))
        live = self.chapters() if guard is None else self.chapters().filter(guard)
        total = live.agg(F.count("*").alias("docs"), F.avg("size").alias("mean"))
        n = range(len(prefixes))
        having = found.agg(*(F.count_if(F.col(f"h{i}") > 0).alias(f"d{i}") for i in n))
        score = F.lit(0.0)
        for i in n:
            h, d = F.col(f"h{i}"), F.col(f"d{i}")
            score = score + F.log(F.lit(1.0) + (F.col("docs") - d + 0.5) / (d + 0.5)) * h * (K1 + 1) / (h + K1 * (1 - B + B * F.col("size") / F.col("mean")))
        hit = [F.col(f"h{i}") > 0 for i in n]
        some = found.filter(functools.reduce(lambda a, b: a & b if every else a | b, hit)).crossJoin(F.broadcast(total)).crossJoin(F.broadcast(having))  # a row each
        return some.select("book", "ch", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "ch", "book").limit(k)

    def hits_by_book(self, question: str, guard: Column | None = None) -> DataFrame:
        """book, chapters, hits of the question's first part, where chapters have all of it."""
        return self.hits(question, True, guard).groupBy("book").agg(F.count("*").alias("chapters"), F.sum("h0").alias("hits"))

    # ---- inside

    def _post(self, blocks: DataFrame, words: int, number: int) -> None:
        """Writes the postings of a batch. What a task sorts doesn't grow with the batch: more words are more tasks, and a number of them that is given isn't made smaller."""
        tasks = max(self.spark.sparkContext.defaultParallelism, -(-words // SORTED))
        # very common letters are dealt over several files by chapter
        dealt = blocks.withColumn("salt", F.pmod(F.xxhash64("chs"), F.lit(self.salts))).repartition(tasks, "first", "second", "salt").drop("salt")
        dealt.sortWithinPartitions("first", "second", "token").write.partitionBy("first", "second").mode("overwrite").parquet(f"{self.path}/postings/batch={number}")

    def _log(self) -> DataFrame:
        return self._read("chapters", _CHAPTERS)

    def _postings(self) -> DataFrame:
        return self._read("postings", _POSTINGS)

    def _path(self, at: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(at)
        return path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), path

    def _read(self, kind: str, schema: str) -> DataFrame:
        fs, path = self._path(f"{self.path}/{kind}")
        return self.spark.read.schema(schema).parquet(f"{self.path}/{kind}") if fs.exists(path) else self.spark.createDataFrame([], schema)

    def _delete(self, at: str) -> None:
        fs, path = self._path(at)
        fs.delete(path, True)

    @staticmethod
    def _newest(log: DataFrame) -> DataFrame:
        return log.groupBy("book", "ch").agg(F.max(F.struct("batch", "version", "digest", "size")).alias("r")).select("book", "ch", "r.version", "r.digest", "r.size", "r.batch")

    def _folded(self, part: list[str]) -> list[str]:
        """A part's words as the index has them."""
        said = " ".join(part[1:])
        return [part[0], *self.spark.range(1).select(plain_words(fold_for_search(F.lit(said)))).first()[0]]

    def _with_word(self, test: Column, word: str, places: bool = False) -> DataFrame:
        """Postings, a row a word of a chapter, whose word passes a test; it begins with word, so only word's folders are read."""
        first, second = self.spark.range(1).select(*_letters(F.lit(word))).first()
        rows = self._postings().filter(F.col("first") == first)
        return _chapter_rows((rows.filter(F.col("second") == second) if len(word) > 1 else rows).filter(test), places)

    def _part(self, part: list[str]) -> DataFrame | None:
        """book, ch, batch, n: hits of one part."""
        words = part[1:]
        if not words:
            return None
        keys = ["book", "ch", "batch"]
        if part[0] == "^":
            # a word with an apostrophe is two words of the index, which no word begins with
            return self._with_word(F.col("token").startswith(" ".join(words)), words[0]).groupBy(*keys).agg(F.sum("tf").cast("int").alias("n"))
        begun = None
        for i, w in enumerate(words):
            starts = self._with_word(F.col("token") == w, w, True).select(*keys, _shifted("places", i).alias(f"s{i}"))
            begun = starts if begun is None else begun.join(starts, keys)
        both = functools.reduce(F.array_intersect, (F.col(f"s{i}") for i in range(len(words))))
        return begun.select(*keys, F.size(both).alias("n")).filter("n > 0")

    def _hits(self, parts: list[list[str]], guard: Column | None) -> DataFrame:
        """book, ch, size, h0 ... of the live chapters that have any part."""
        each = [x.withColumn("part", F.lit(i)) for i, p in enumerate(parts) if (x := self._part(p)) is not None]
        live = self.chapters().filter(guard) if guard is not None else self.chapters()
        names = [f"h{i}" for i in range(len(parts))]
        if not each:
            return live.limit(0).select("book", "ch", "size", *(F.lit(0).alias(h) for h in names or ["h0"]))
        rows = functools.reduce(DataFrame.unionByName, each).groupBy("book", "ch", "batch")
        counts = rows.agg(*(F.coalesce(F.max(F.when(F.col("part") == i, F.col("n"))), F.lit(0)).alias(h) for i, h in enumerate(names)))
        return counts.join(live.select("book", "ch", "batch", "size"), ["book", "ch", "batch"]).select("book", "ch", "size", *names)
