"""Substring deduplication with a log-structured fingerprint index (operator 2).

A window is 13 consecutive words.  A word is removed if a window over it also starts in a document with a
smaller id.  The work goes from coarse to fine, each step on what the one before left:

1. Of each window the least hash of its 5-word grams is kept, which neighbouring windows mostly share.
   Two documents with a window in common have its least gram in common, so windows whose gram no other
   document has are settled.  Grams are combined per run of 512 neighbouring rows before they are dealt out.
2. The windows that remain, as a 64-bit and a 32-bit hash with the ids that have them, go batch by batch, in the
   order of ids, through the index: immutable runs of earlier windows, bucketed and sorted by hash, so that a
   batch is dealt out once and merge-joined with each run where it lies; it then becomes a run itself.  When
   there are too many runs they are compacted into one.  A match counts only if both hashes agree.
3. The runs of rows get their windows' first ids back and cut the covered words out.

With an index that is kept in a folder, new documents are compared with all that came before without reading
them again: step 1 is left out then, as it needs all texts at hand, and every window goes through the index.
A run of rows is 512 neighbouring rows, but a text of more than LONG characters is a run of its own, so a task
holds 512 x LONG characters or one text at a time.

Exact copies of a whole text are found first, natively, so that they need no windows: all their words go
if there are at least 13.  Nothing is gathered per gram or window: a hot one is one row per run of rows.

Defined results: a null text has no words; documents with fewer than 13 words lose none; rows with the
same id don't remove each other's words; rows with a null id keep all words and remove none elsewhere;
an empty table gives an empty table; other columns are not touched.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vitrine.llm.common import discard, new_path, own_shuffles, packed, release, remove, ship, stage, unpack
from vitrine.llm.exact_dedup import exact_dedup, read_of_files, with_row
from vitrine.llm.grams import Words, sliding_min, small_groups

WINDOW, GRAM = 13, 5
RUN_BITS = 9  # rows to a run: 512
LONG = 65_536  # characters
SECOND = 0xA0761D6478BD642F
KEY = ["h1", "h2"]


class FingerprintIndex:
    """Immutable runs of (h1, h2, first), the smallest id known for each window, as bucketed and sorted tables.

    folder: where the index is kept; one that is there is opened.  Without a folder it goes when it is closed.
    buckets: of each run, fixed when the index is made (default: the number of shuffle partitions).
    Runs are in the session's catalogue while they are worked with; close() takes them out, and the files of
    runs that a later version no longer lists go with it.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, most_runs: int = 4, buckets: int | None = None) -> None:
        self.spark, self.most_runs, self.kept = spark, most_runs, folder is not None
        self.folder = folder or new_path(spark, "index")
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.runs: list[str] = []
        self.written: list[str] = []  # and not among the runs
        self.version = 0
        if folder:
            self._open()

    def _open(self) -> None:
        """The newest list of runs; a folder without one is a new index."""
        try:
            lists = self.spark.read.schema("run string, buckets int, version int").json(f"{self.folder}/runs")
            newest = lists.filter(F.col("version") == lists.agg(F.max("version")).first()[0]).orderBy("run").collect()  # at most most_runs rows
        except AnalysisException:
            return
        for r in newest:
            self.version, self.buckets = r["version"], r["buckets"]
            self.runs.append(r["run"])

    def table(self, run: str) -> DataFrame:
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {run} (h1 BIGINT, h2 INT, first BIGINT, _new BOOLEAN, _hit BOOLEAN, _run BIGINT) USING parquet "
            f"CLUSTERED BY (h1, h2) SORTED BY (h1, h2) INTO {self.buckets} BUCKETS LOCATION '{self.folder}/{run}'"
        )
        return self.spark.table(run)

    def _write(self, rows: DataFrame) -> str:
        name = f"vitrine_run_{uuid.uuid4().hex}"
        with own_shuffles(self.spark):
            writer = rows.write.option("compression", "zstd").option("path", f"{self.folder}/{name}").format("parquet")
            writer.bucketBy(self.buckets, *KEY).sortBy(*KEY).saveAsTable(name)
        return name

    def _commit(self) -> None:
        """List the runs of this version; lists are added, never changed, so a lost driver leaves the last one valid."""
        self.version += 1
        if self.kept:
            rows = self.spark.createDataFrame([(r, self.buckets, self.version) for r in self.runs], "run string, buckets int, version int")
            rows.coalesce(1).write.mode("append").json(f"{self.folder}/runs")

    def entries(self, run: str) -> DataFrame:
        return self.table(run).filter("_new").select(*KEY, "first")

    def merge(self, batch: DataFrame, last: bool = False) -> DataFrame:
        """batch: (_run, h1, h2, lo, hi), the smallest and largest id of each window in a run of rows.

        Returns (_run, h1, h2, first) for the windows that some document of the run has after an earlier
        one, and adds the batch to the index, unless it is the last that there will be.  What it returns can be
        read until the index is closed.
        """
        known = batch.repartition(self.buckets, *KEY)
        for k, run in enumerate(self.runs):
            known = known.join(self.entries(run).withColumnRenamed("first", f"_f{k}").hint("merge"), KEY, "left")
        old = [F.col(f"_f{k}") for k in range(len(self.runs))]
        old = F.least(*old) if len(old) > 1 else old[0] if old else F.lit(None).cast("long")
        order = Window.partitionBy(*KEY).orderBy("lo", "_run")
        told = known.withColumn("_old", old).withColumn("_here", F.first("lo").over(order)).withColumn("_n", F.row_number().over(order))
        new = (F.col("_n") == 1) & (F.col("_old").isNull() | (F.col("lo") < F.col("_old")))
        told = told.withColumn("first", F.least("_here", "_old"))
        told = told.select(*KEY, "first", new.alias("_new"), (F.col("first") < F.col("hi")).alias("_hit"), "_run")
        run = self._write(told.filter("_hit" if last else "_hit or _new"))
        if last:
            self.written.append(run)
        else:
            self.runs.append(run)
            if len(self.runs) > self.most_runs:
                self.compact()
            self._commit()
        return self.spark.table(run).filter("_hit").select("_run", *KEY, "first")

    def compact(self) -> None:
        """All runs into one."""
        found = self.entries(self.runs[0])
        for run in self.runs[1:]:
            found = found.unionByName(self.entries(run))
        one = found.groupBy(*KEY).agg(F.min("first").alias("first"))
        one = one.select(*KEY, "first", F.lit(True).alias("_new"), F.lit(False).alias("_hit"), F.lit(None).cast("long").alias("_run"))
        self.written += self.runs
        self.runs = [self._write(one)]

    def close(self) -> None:
        """Leave nothing in the catalogue, and no files but those of a kept index's runs."""
        for run in [*self.runs, *self.written]:
            self.spark.sql(f"DROP TABLE IF EXISTS {run}")  # its files stay where they are
        for run in self.written:
            remove(self.spark, f"{self.folder}/{run}")
        self.written = []
        if not self.kept:
            discard(self.spark, self.folder)
            self.runs = []


def least_grams(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(least gram, valid) of each window."""
    grams, _ = words.grams(GRAM)
    low = sliding_min(grams, WINDOW - GRAM + 1) if len(words.hash) >= WINDOW else grams[:0]
    return low, words.doc[: len(low)] == words.doc[WINDOW - 1 :]


def second_hash(words: Words) -> np.ndarray:
    return (words.grams(WINDOW, SECOND)[0] >> np.uint64(32)).astype(np.uint32).view(np.int32)


def run_of(row: Column, text: Column) -> Column:
    """The run of a row: even numbers are 512 neighbouring rows, odd ones a long text alone."""
    alone = F.length(text) > LONG
    return F.when(alone, F.shiftleft(row, 1) + 1).otherwise(F.shiftleft(F.shiftright(row, RUN_BITS), 1))


def run_grams(docs: DataFrame) -> DataFrame:
    """(_run, gram, several): the least grams of each stretch of rows of a run, and whether more than one row there has them."""

    def run(batches):
        for batch in batches:
            runs = batch.column(0).to_pylist()
            texts = batch.column(1).to_pylist()
            at = 0
            while at < len(runs):
                stop = at
                while stop < len(runs) and runs[stop] == runs[at]:
                    stop += 1
                grams, owners = [], []
                for k, group in small_groups(texts[at:stop]):
                    words = Words(group)
                    low, valid = least_grams(words)
                    valid[1:] &= (low[1:] != low[:-1]) | (words.doc[1 : len(low)] != words.doc[: len(low)][:-1])
                    grams.append(low[valid])
                    owners.append(words.doc[: len(low)][valid] + k)
                gram, owner = np.concatenate(grams), np.concatenate(owners)
                order = np.lexsort((owner, gram))
                gram, owner = gram[order], owner[order]
                new = np.append(True, gram[1:] != gram[:-1])[: len(gram)]
                begin = np.flatnonzero(new)
                last = np.append(begin[1:], len(gram)) - 1
                several = owner[begin] != owner[last[: len(begin)]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(begin), runs[at])), pa.array(gram[begin].view(np.int64)), pa.array(several)],
                    names=["_run", "gram", "several"],
                )
                at = stop

    return docs.select("_run", "_text").mapInArrow(run, "_run long, gram long, several boolean")


def shared_grams(rows: DataFrame) -> DataFrame:
    """(_run, gram) of the grams that more than one row of the corpus has.

    A run that an Arrow batch or a split of a file cuts in two has an entry from each part; as a row is in one
    part only, two entries of a gram are two rows, whatever their runs.
    """
    same = Window.partitionBy("gram")
    both = rows.select("_run", "gram", (F.count(F.lit(1)).over(same) > 1).alias("_far"), F.max("several").over(same).alias("_near"))
    return both.filter(F.col("_far") | F.col("_near")).select("_run", "gram")


OUT = pa.schema([
    ("kind", pa.int32()), ("_run", pa.int64()), ("_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string()),
    ("text", pa.binary()), ("hits", pa.list_(pa.int32())),
])
OUT_DDL = "kind int, _run long, _id long, n_words long, n_removed long, kept string, text binary, hits array<int>"
DONE, OPEN = 0, 1


def sift(key, rows: pa.Table, found: pa.Table) -> pa.Table:
    """For one run of rows: settle what needs no windows; pass on the other texts with the spans of their windows to look up."""
    shared = np.unique(found.column("gram").drop_null().to_numpy().view(np.uint64))
    copies = set(found.column("_copy").drop_null().to_pylist())
    number = key[0].as_py()
    ids, small, numbers = (rows.column(c).to_pylist() for c in ("_id", "_text", "_row"))
    out: list[dict] = []
    for at, group in small_groups(unpack(small)):
        words = Words(group)
        low, valid = least_grams(words)
        hit = valid & np.isin(low, shared) if len(shared) else np.zeros(len(low), bool)
        for k in range(len(group)):
            a, b = int(words.first[k]), int(words.first[k + 1])
            doc, n = ids[at + k], b - a
            row = {"_run": number, "_id": doc, "n_words": n, "n_removed": 0}
            mine = hit[a:b] if doc is not None and numbers[at + k] not in copies else hit[:0]
            if numbers[at + k] in copies and n >= WINDOW:
                out.append(row | {"kind": DONE, "n_removed": n, "kept": hashlib.sha256(b"").hexdigest()})
            elif mine.any():
                edges = np.flatnonzero(np.diff(mine.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
                out.append(row | {"kind": OPEN, "text": small[at + k], "hits": edges.astype(np.int32)})
            else:
                out.append(row | {"kind": DONE, "kept": hashlib.sha256(words.text(np.arange(a, b))).hexdigest()})
    return pa.Table.from_pylist(out, OUT)


def all_open(rows: DataFrame) -> DataFrame:
    """Every row as sift() passes on those with windows to look up; rows without an id or a window are settled."""

    def run(batches):
        for lot in (whole.slice(at, 256) for whole in batches for at in range(0, whole.num_rows, 256)):
            out = []
            ids, small = lot.column(1).to_pylist(), lot.column(2).to_pylist()
            for at, group in small_groups(unpack(small)):
                words = Words(group)
                for k in range(len(group)):
                    a, b = int(words.first[k]), int(words.first[k + 1])
                    row = {"_run": lot.column(0)[at + k].as_py(), "_id": ids[at + k], "n_words": b - a, "n_removed": 0}
                    if ids[at + k] is None or b - a < WINDOW:
                        out.append(row | {"kind": DONE, "kept": hashlib.sha256(words.text(np.arange(a, b))).hexdigest()})
                    else:
                        out.append(row | {"kind": OPEN, "text": small[at + k], "hits": [0, b - a - WINDOW + 1]})
            yield from pa.Table.from_pylist(out, OUT).to_batches()

    return packed(rows.select("_run", "_id", "_text")).mapInArrow(run, OUT_DDL)


def window_entries(open_rows: DataFrame) -> DataFrame:
    """(_run, h1, h2, lo, hi): the windows to look up, with the smallest and largest id that has them in a run of rows."""

    def run(batches):
        for whole in batches:
            for lot in (whole.slice(at, 256) for at in range(0, whole.num_rows, 256)):
                runs, ids = lot.column(0).to_numpy(), lot.column(1).to_numpy()
                texts, hits = unpack(lot.column(2).to_pylist()), lot.column(3).to_pylist()
                for at, group in small_groups(texts):
                    words = Words(group)
                    marks = np.zeros(len(words.hash) + 1, np.int64)
                    for k in range(len(group)):
                        np.add.at(marks, np.array(hits[at + k]) + int(words.first[k]), np.resize([1, -1], len(hits[at + k])))
                    here = np.flatnonzero(np.cumsum(marks)[:-1])
                    owner = words.doc[here] + at
                    h1, h2 = words.grams(WINDOW)[0][here].view(np.int64), second_hash(words)[here]
                    group_of, doc = runs[owner], ids[owner]
                    order = np.lexsort((doc, h2, h1, group_of))
                    group_of, h1, h2, doc = group_of[order], h1[order], h2[order], doc[order]
                    new = np.append(True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]) | (group_of[1:] != group_of[:-1]))[: len(h1)]
                    begin = np.flatnonzero(new)
                    last = (np.append(begin[1:], len(h1)) - 1)[: len(begin)]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (group_of[begin], h1[begin], h2[begin], doc[begin], doc[last])], names=["_run", *KEY, "lo", "hi"])

    return open_rows.select("_run", "_id", "text", "hits").mapInArrow(run, "_run long, h1 long, h2 int, lo long, hi long")


def cut(key, rows: pa.Table, found: pa.Table) -> pa.Table:
    """For one run of rows: remove the words under windows that an earlier document has."""
    h1, h2, first = (found.column(c).to_numpy() for c in ("h1", "h2", "first"))
    h1 = h1.view(np.uint64)
    order = np.lexsort((h2, h1))
    h1, h2, first = h1[order], h2[order], first[order]
    ids, texts = rows.column("_id").to_pylist(), unpack(rows.column("text").to_pylist())
    out = []
    for at, group in small_groups(texts):
        words = Words(group)
        g1, valid = words.grams(WINDOW)
        g2 = second_hash(words)
        for k in range(len(group)):
            a, b = int(words.first[k]), int(words.first[k + 1])
            mine = np.flatnonzero(valid[a:b]) + a
            gone = np.zeros(b - a + 1, np.int64)
            # equal first hashes stand together; nearly always there is one second hash to each
            at1, at2 = np.searchsorted(h1, g1[mine], "left"), np.searchsorted(h1, g1[mine], "right")
            step = 0
            while len(look := np.flatnonzero(at1 + step < at2)):
                p = at1[look] + step
                hit = mine[look[(h2[p] == g2[mine[look]]) & (first[p] < ids[at + k])]] - a
                np.add.at(gone, hit, 1)
                np.add.at(gone, hit + WINDOW, -1)
                step += 1
            covered = np.cumsum(gone)[: b - a] > 0
            kept = words.text(np.flatnonzero(~covered) + a)
            out.append({"_id": ids[at + k], "n_words": b - a, "n_removed": int(covered.sum()), "kept": hashlib.sha256(kept).hexdigest(), "text": kept.decode("utf-8", "replace")})
    return pa.Table.from_pylist(out, CUT)


CUT = pa.schema([("_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string()), ("text", pa.string())])
CUT_DDL = "_id long, n_words long, n_removed long, kept string, text string"


def remove_repeats(
    docs: DataFrame, batches: int = 6, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, index: FingerprintIndex | None = None
) -> DataFrame:
    """id, n_words, n_removed, kept_sha256 of each row; with_text: kept_text too, of the rows that lose words (null: as it was).

    Ids are integers.  index: what earlier calls have seen, to which these documents are added; a window counts
    as repeated if it starts in a document with a smaller id, here or in the index.
    """
    ship(docs.sparkSession)
    docs = read_of_files(docs)
    rows = with_row(docs, F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    rows = rows.withColumn("_run", run_of(F.col("_row"), F.coalesce("_text", F.lit(""))))
    if index:
        sifted, batches = stage(all_open(rows), "sifted"), 1
    else:
        grams = stage(shared_grams(run_grams(rows)), "grams")
        copies = exact_dedup(docs, id_col, text_col, fold=False).filter(F.col("keep_id") < F.col(id_col)).select("_row")
        copies = rows.select("_row", "_run").join(copies, "_row")
        told = grams.select("_run", "gram", F.lit(None).cast("long").alias("_copy")).unionByName(
            copies.select("_run", F.lit(None).cast("long").alias("gram"), F.col("_row").alias("_copy"))
        )
        sides = packed(rows).groupBy("_run").cogroup(told.groupBy("_run"))
        sifted = stage(sides.applyInArrow(sift, OUT_DDL), "sifted")
        release(grams)
    open_rows = sifted.filter(F.col("kind") == OPEN)
    bounds = batch_bounds(open_rows, batches)
    seen = index or FingerprintIndex(docs.sparkSession)
    hits = None
    for k, (a, b) in enumerate(zip([None, *bounds], [*bounds, None], strict=True)):
        mine = (F.lit(True) if a is None else F.col("_id") >= a) & (F.lit(True) if b is None else F.col("_id") < b)
        found = seen.merge(window_entries(open_rows.filter(mine)), last=index is None and k == len(bounds))
        hits = found if hits is None else hits.unionByName(found)
    cut_rows = open_rows.select("_run", "_id", "text").groupBy("_run").cogroup(hits.groupBy("_run")).applyInArrow(cut, CUT_DDL)
    done = sifted.filter(F.col("kind") == DONE)
    kept_text = F.when(F.col("n_removed") > 0, F.coalesce(F.col("text").cast("string"), F.lit("")))
    both = [x.select(F.col("_id").alias(id_col), "n_words", "n_removed", F.col("kept").alias("kept_sha256"), *([kept_text.alias("kept_text")] if with_text else [])) for x in (done, cut_rows)]
    result = stage(both[0].unionByName(both[1]), "kept")
    seen.close()
    release(sifted)
    return result


def batch_bounds(rows: DataFrame, batches: int) -> list[int]:
    """Ids that cut rows (_id) in batches of about as many rows each; fewer where an id has more than a batch."""
    found = rows.agg(F.percentile_approx("_id", F.array(*(F.lit(k / batches) for k in range(1, batches))), F.lit(10_000)).alias("q")).first()["q"] if batches > 1 else []
    return sorted(set(found or []))
