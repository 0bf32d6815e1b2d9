"""Search of many questions in a stored index: nearest hashed terms, and BM25.

The index is written once, in parts of bounded size, into the folder of the
checkpoints.  One task takes a block of questions through all parts, so that
neither side is copied in a shuffle, and bounds on what a passage can score spare
most of the work.  The results are those of scoring every passage.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pa_fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import search_terms
from .lineage import checkpointed, cleaned, dropped, scratch_folder, stored

# The constants of the lexical score.
K1, B, EPSILON = 1.5, 0.75, 0.25
#: Decimals to which scores are held before they are ranked, so that the order of summation decides nothing.
DIGITS = 9
#: Numbers of a hashed term vector.
DIMENSIONS = 64
#: Passages of a part of the index, and of a run of a part that one bound is held against; questions of a block.
PART, RUN, BLOCK = 131072, 256, 16384
#: Bounds are held this much below the score to beat, more than summation can lose.
LOSS = 1e-7
#: Parts of a score that BM25 bounds are counted in; a word in more than one of so many passages of a part gets a column.
STEP, COMMON = 0.01, 64
#: Pairs of question and passage whose words are compared at once.
PAIRS = 65536


def best_places(row: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest values, of equal ones the first."""
    if len(row) > k:
        least = np.partition(row, len(row) - k)[len(row) - k]
        above = np.flatnonzero(row > least)
        some = np.sort(np.append(above, np.flatnonzero(row == least)[: k - len(above)]))
    else:
        some = np.arange(len(row))
    return some[np.argsort(-row[some], kind="stable")]


def _place(term: str) -> int:
    """On which of the DIMENSIONS a term falls."""
    return int(md5(term.encode()).hexdigest()[:4], 16) % DIMENSIONS


_PART = "n bigint, words bigint, ids array<string>, vocabulary array<string>, df array<bigint>, ends binary, owners binary, tf binary, dl binary, counts binary, width string"
_ARROW = {"bigint": pa.int64(), "array<string>": pa.list_(pa.string()), "array<bigint>": pa.list_(pa.int64()), "binary": pa.binary(), "string": pa.string()}


def _pack(ids: np.ndarray, terms: pa.ListArray) -> dict[str, object]:
    """A part of the index: its passages by falling density of their vectors, the postings of each
    term in their order, and for each of the DIMENSIONS how many terms of a passage fall on it."""
    sizes = np.diff(terms.offsets.to_numpy())
    coded = terms.flatten().dictionary_encode()
    vocabulary, n = coded.dictionary, len(ids)
    several = np.sort(np.repeat(np.arange(n), sizes) * len(vocabulary) + coded.indices.to_numpy().astype(np.int64))
    starts = np.flatnonzero(np.diff(several, prepend=-1))
    tf = np.diff(starts, append=len(several))
    owner, term = np.divmod(several[starts], max(1, len(vocabulary)))
    place = np.array([_place(w) for w in vocabulary.to_pylist()], np.int64)
    counts = np.bincount(owner * DIMENSIONS + place[term], minlength=n * DIMENSIONS).reshape(n, DIMENSIONS)
    order = np.argsort((counts * counts).sum(1), kind="stable")
    at = np.empty(n, np.int64)
    at[order] = np.arange(n)
    counts, tf = (x.astype(np.min_scalar_type(int(x.max(initial=0)))) for x in (counts[order].T, tf))
    posted = np.argsort(term * n + at[owner])
    term = term[posted]
    ends = np.searchsorted(term, np.arange(len(vocabulary) + 1))
    return {
        "n": n, "words": int(sizes.sum()), "ids": ids[order].tolist(), "vocabulary": vocabulary.to_pylist(), "df": np.diff(ends).tolist(), "ends": ends.tobytes(), "owners": at[owner][posted].astype(np.int32).tobytes(),
        "tf": tf[posted].tobytes(), "dl": sizes[order].astype(np.int32).tobytes(), "counts": np.ascontiguousarray(counts).tobytes(), "width": f"{counts.dtype},{tf.dtype}",
    }


def store_index(passages: DataFrame, part: int = PART) -> tuple[str, DataFrame]:
    """Folder of the index of the passages (chunk_id, text), and its rows, one for each part.

    The parts are partitions of the passages put together, so nothing is shuffled."""
    folder = scratch_folder(passages.sparkSession)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def made() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            row = _pack(np.array(t.column("chunk_id").to_pylist(), object), pa.concat_arrays(t.column("terms").chunks))
            held.clear()
            return pa.RecordBatch.from_pylist([row], schema)

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= 2 * part:
                yield made()
        if sum(b.num_rows for b in held):
            yield made()

    schema = pa.schema([(name, _ARROW[kind]) for name, kind in (c.split() for c in _PART.split(", "))])
    none = F.expr("cast(array() as array<string>)")
    terms = passages.select("chunk_id", F.coalesce(search_terms(F.col("text")), none).alias("terms"))
    with cleaned(passages.sparkSession):
        terms.coalesce(max(1, -(-passages.count() // part))).mapInArrow(pack, _PART).write.option("compression", "zstd").parquet(folder)
    return folder, passages.sparkSession.read.schema(_PART).parquet(folder)


def _parts(folder: str) -> Iterator[dict[str, object]]:
    """The parts of a stored index, one at a time."""
    fs, path = pa_fs.FileSystem.from_uri(folder)
    for f in sorted(x.path for x in fs.get_file_info(pa_fs.FileSelector(path)) if x.path.endswith(".parquet")):
        for batch in pq.ParquetFile(fs.open_input_file(f)).iter_batches(1):
            get = lambda c, dtype, b=batch: np.frombuffer(b.column(c)[0].as_buffer(), dtype)
            narrow, tf = batch.column("width")[0].as_py().split(",")
            yield {
                "ids": batch.column("ids")[0].values, "vocabulary": batch.column("vocabulary")[0].values, "ends": get("ends", np.int64), "owners": get("owners", np.int32), "tf": get("tf", tf), "dl": get("dl", np.int32),
                "counts": get("counts", narrow).reshape(DIMENSIONS, -1),
            }


class Found:
    """The k best of each question over the parts seen so far: scores, their parts and places."""

    def __init__(self, n: int, k: int) -> None:
        self.k, self.least = k, np.full(n, -np.inf)
        self.held: list[tuple[np.ndarray, np.ndarray] | None] = [None] * n
        self.ids: list[pa.Array] = []
        self.first: list[int] = []

    def start_part(self, ids: pa.Array) -> None:
        self.first.append(self.first[-1] + len(self.ids[-1]) if self.ids else 0)
        self.ids.append(ids)
        self.rank: np.ndarray | None = None

    def by_id(self) -> np.ndarray:
        """Place of each passage of this part in the order of ids."""
        if self.rank is None:
            self.rank = np.empty(len(self.ids[-1]), np.int64)
            self.rank[np.argsort(np.array(self.ids[-1].to_pylist(), object), kind="stable")] = np.arange(len(self.rank))
        return self.rank

    def add(self, q: int, at: np.ndarray, scores: np.ndarray) -> None:
        k = self.k
        if len(at) > 4 * k:  # of equal scores the smaller ids
            best = np.lexsort((self.by_id()[at], -scores))[:k]
            at, scores = at[best], scores[best]
        at = at + self.first[-1]
        if (held := self.held[q]) is not None:
            at, scores = np.concatenate((held[0], at)), np.concatenate((held[1], scores))
        if len(scores) >= k:
            self.least[q] = least = np.partition(scores, len(scores) - k)[len(scores) - k]
            keep = scores >= least
            at, scores = at[keep], scores[keep]
            if len(at) > 8 * k:
                best = self._sorted(at, scores)
                at, scores = at[best], scores[best]
        self.held[q] = at, scores

    def names(self, at: np.ndarray) -> list[str]:
        part = np.searchsorted(self.first, at, "right") - 1
        return [self.ids[p][i - self.first[p]].as_py() for p, i in zip(part.tolist(), at.tolist(), strict=True)]

    def _sorted(self, at: np.ndarray, scores: np.ndarray) -> list[int]:
        names = self.names(at)
        return sorted(range(len(at)), key=lambda i: (-scores[i], names[i]))[: self.k]

    def settle(self) -> tuple[np.ndarray, np.ndarray]:
        """Leaves the k best of each question, in their order; their questions and places."""
        for q, held in enumerate(self.held):
            if held is not None:
                best = self._sorted(*held)
                self.held[q] = held[0][best], held[1][best]
        sizes = [0 if h is None else len(h[0]) for h in self.held]
        return np.repeat(np.arange(len(sizes)), sizes), np.concatenate([np.zeros(0, np.int64), *(h[0] for h in self.held if h is not None)])

    def best(self, q: int) -> list[tuple[str, float]]:
        """The settled rows of a question."""
        if self.held[q] is None:
            return []
        at, scores = self.held[q]
        return list(zip(self.names(at), scores.tolist(), strict=True))


def _padded(n: int) -> int:
    """n, or the next whole number of runs."""
    return -(-n // RUN) * RUN


def _at_least(grid: np.ndarray, most: np.ndarray, need: np.ndarray) -> np.ndarray:
    """Places of the runs in grid that reach what their run needs; most is the largest number of each run."""
    some = (most >= need).nonzero()[0]
    at = (grid[some] >= need[some, None]).ravel().nonzero()[0]
    return some[at // RUN] * RUN + at % RUN


def _near(found: Found, vectors: np.ndarray, counts: np.ndarray) -> None:
    """The nearest passages of a part: counts are added up column by column for each question.
    A run holds passages of about equal length, so that its largest sum bounds its scores."""
    n = counts.shape[1]
    total = np.zeros(n, np.int64)
    for column in counts:
        total += column.astype(np.int64) ** 2
    norms = np.sqrt(total)
    counts = np.pad(counts, ((0, 0), (0, _padded(n) - n)))
    lengths = np.sqrt((vectors * vectors).sum(1))
    shortest, longest = norms[::RUN], np.maximum(np.append(norms[RUN - 1 : n - 1 : RUN], norms[-1:]), 1)
    most_each = counts.max(1).astype(np.int64)
    narrow, wide = np.zeros(counts.shape[1], counts.dtype), np.zeros(counts.shape[1], np.int64)
    limit, k = np.iinfo(counts.dtype).max, found.k
    asked = [np.repeat(np.flatnonzero(v), v[v > 0]).tolist() for v in vectors]
    for q, (dims, length) in enumerate(zip(asked, lengths.tolist(), strict=True)):
        row = narrow if vectors[q] @ most_each <= limit else wide
        row[:] = counts[dims[0]] if dims else 0
        for d in dims[1:]:
            np.add(row, counts[d], out=row)
        grid = row.reshape(-1, RUN)
        most = grid.max(1)
        least = found.least[q]
        if dims and len(most) >= k:  # k runs each hold a passage as good as this
            least = max(least, np.partition(most / longest, len(most) - k)[len(most) - k] / length - LOSS)
        at = _at_least(grid, most, np.maximum(1, np.ceil((least - LOSS) * length * shortest)).astype(np.int64)) if least > LOSS else np.arange(n)
        if len(at):
            norm = norms[at] * length
            score = np.round(np.divide(row[at], norm, out=np.zeros(len(at)), where=norm > 0), DIGITS)
            keep = score >= least
            if keep.any():
                found.add(q, at[keep], score[keep])


def _lexical(found: Found, asked: list[list[tuple[int, int, float]]], words: pa.Array, part: dict[str, object], avgdl: float) -> None:
    """The best passages of a part by BM25: what the words (word, times, idf) of a question
    give each passage is added up in whole steps, each rounded up, and the passages whose sum
    may reach the score to beat are scored exactly."""
    place = pc.index_in(words, part["vocabulary"]).fill_null(-1).to_numpy()
    ends, owners, tf, n = part["ends"], part["owners"], part["tf"], len(part["dl"])
    base = K1 * (1 - B + B * part["dl"] / avgdl) if avgdl else np.full(n, K1)
    lists: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, int, bool]] = {}

    def postings_of(w: int, idf: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, bool]:
        """Passages with a word, what it gives them, the same in steps, the most of those, and whether the steps are a column."""
        if w not in lists:
            a, z = ends[place[w]], ends[place[w] + 1]
            own, times = owners[a:z].astype(np.int64), tf[a:z].astype(float)
            gain = idf * times * (K1 + 1) / (times + base[own])
            steps = np.ceil(np.maximum(gain, 0) / STEP)
            most = int(steps.max())
            steps = steps.astype(np.uint16 if most < 65536 else np.int64)
            if common := len(own) * COMMON > n:
                column = np.zeros(_padded(n), steps.dtype)
                column[own] = steps
                steps = column
            lists[w] = own, gain, steps, most, common
        return lists[w]

    narrow, wide, k = np.zeros(_padded(n), np.uint16), np.zeros(_padded(n), np.int64), found.k
    by_id = np.argsort(found.by_id()) if any(idf <= 0 for terms in asked for _, _, idf in terms) else None
    for q, terms in enumerate(asked):
        here = [(times, *postings_of(w, idf)) for w, times, idf in terms if place[w] >= 0]
        if by_id is not None:  # passages that share words may score below those that share none
            sums = np.zeros(n)
            for times, own, gain, _, _, _ in here:
                sums[own] += times * gain
            sums = np.round(sums, DIGITS)
            best = by_id[best_places(sums[by_id], k)]
            found.add(q, best, sums[best])
            continue
        highest = sum(x[0] * x[4] for x in here)
        least = found.least[q]
        if not here or highest * STEP < least - LOSS:
            continue
        row = narrow if highest < 65536 else wide
        here.sort(key=lambda x: not x[5])  # columns first
        row[:] = here[0][3] if here[0][5] and here[0][0] == 1 else 0
        for i, (times, own, _, steps, _, common) in enumerate(here):
            for _ in range(times - (i == 0 and common and times == 1)):
                if common:
                    np.add(row, steps, out=row)
                else:
                    row[own] += steps
        grid = row.reshape(-1, RUN)
        most = grid.max(1)
        if len(most) >= k:  # k runs each hold a passage as good as this, but for the rounding up
            least = max(least, (int(np.partition(most, len(most) - k)[len(most) - k]) - sum(x[0] for x in here)) * STEP - LOSS)
        at = _at_least(grid, most, np.full(len(most), max(1, int((least - LOSS) / STEP)) if least > 0 else 1, np.int64))
        score = np.zeros(len(at))
        if not len(at):
            continue
        for times, own, gain, _, _, _ in here:
            to = np.minimum(own.searchsorted(at), len(own) - 1)
            score += np.where(own[to] == at, times * gain[to], 0.0)
        score = np.round(score, DIGITS)
        keep = score >= found.least[q]
        if keep.any():
            found.add(q, at[keep], score[keep])


def _held(asked: np.ndarray, ends: np.ndarray, rows: np.ndarray, at: np.ndarray, part: dict[str, object]) -> np.ndarray:
    """How many words of a question each passage of a part holds: question rows[i] asks the
    different words asked[ends[row] : ends[row + 1]], by their number in the part or -1, and the
    passage is at[i]."""
    n, df = len(part["dl"]), np.diff(part["ends"])
    posted = np.repeat(np.arange(len(df)) * n, df) + part["owners"]  # in rising order
    out = np.zeros(len(rows), np.int64)
    for i in range(0, len(rows), PAIRS):
        some = rows[i : i + PAIRS]
        sizes = ends[some + 1] - ends[some]
        pair = np.repeat(np.arange(len(some)), sizes)
        word = asked[np.arange(len(pair)) - np.repeat(np.cumsum(sizes) - sizes - ends[some], sizes)].astype(np.int64)
        pair = pair[known := word >= 0]
        wanted = word[known] * n + at[i : i + PAIRS][pair]
        order = np.argsort(wanted)  # searched for in rising order, so that memory is read in one direction
        pair, wanted = pair[order], wanted[order]
        to = np.minimum(posted.searchsorted(wanted), max(len(posted) - 1, 0))
        out[i : i + PAIRS] = np.bincount(pair[posted[to] == wanted], minlength=len(some)) if len(wanted) else 0
    return out


def search(questions: DataFrame, passages: DataFrame, dense_k: int, bm25_k: int, block: int = BLOCK, part: int = PART) -> DataFrame:
    """(qid, is_dense, chunk_id, score, rank, overlap): the dense_k nearest passages by their
    hashed terms and the bm25_k best ones by BM25; a search of 0 passages is left out.
    overlap is the share of the question's different words that the passage holds.

    A question word counts as often as it is asked.  Questions with fewer than bm25_k
    passages that share a word are filled up with passages of score 0."""
    folder, index = store_index(passages, part)
    try:
        return stored(_searched(questions, folder, index, dense_k, bm25_k, block))
    finally:
        dropped(passages.sparkSession, folder)


def term_weights(df: DataFrame, n: int) -> DataFrame:
    """(term, idf) from (term, df) over n passages: a negative idf is replaced by a part of
    the vocabulary's mean."""
    idf = df.select("term", (F.log(F.lit(float(n)) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
    mean = idf.agg(F.avg("raw").alias("mean"))
    floor = F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw"))
    return idf.join(F.broadcast(mean), how="cross").select("term", floor.alias("idf"))  # one row


def _searched(questions: DataFrame, folder: str, index: DataFrame, dense_k: int, bm25_k: int, block: int) -> DataFrame:
    totals = index.agg(F.sum("n").alias("n"), F.sum("words").alias("words")).first()
    n = totals["n"] or 0
    avgdl = (totals["words"] or 0) / max(n, 1)
    df = index.select(F.explode(F.arrays_zip("vocabulary", "df")).alias("v")).groupBy(F.col("v.vocabulary").alias("term")).agg(F.sum("v.df").cast("double").alias("df"))
    words = questions.select("qid", F.explode_outer(search_terms(F.col("question"))).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("times"))
    weighted = words.join(checkpointed(words.select("term").distinct().join(term_weights(df, n), "term")), "term", "left")
    asked = weighted.groupBy("qid").agg(F.collect_list(F.when(F.col("term").isNotNull(), F.struct("term", "times", F.coalesce("idf", F.lit(float("nan"))).alias("idf")))).alias("w"))
    asked = checkpointed(asked.select(F.col("qid").cast("string").alias("qid"), F.col("w.term").alias("terms"), F.col("w.times").alias("times"), F.col("w.idf").alias("idfs")))
    n_asked = asked.count()
    cores = questions.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, -(-n_asked // block), min(2 * cores, -(-n_asked // 1024)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= 2 * block:
                yield from answered(pa.Table.from_batches(held))
                held = []
        if sum(b.num_rows for b in held):
            yield from answered(pa.Table.from_batches(held))

    def answered(table: pa.Table) -> Iterator[pa.RecordBatch]:
        terms, times, idfs = (pa.concat_arrays(table.column(c).chunks) for c in ("terms", "times", "idfs"))
        ends, coded = terms.offsets.to_numpy(), terms.flatten().dictionary_encode()
        codes, often, each = coded.indices.to_numpy(), times.flatten().to_numpy(), idfs.flatten().to_numpy()
        words, place = coded.dictionary, np.array([_place(w) for w in coded.dictionary.to_pylist()], np.int64)
        owner = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
        vectors = np.bincount(owner * DIMENSIONS + place[codes] if len(codes) else owner, minlength=(len(ends) - 1) * DIMENSIONS).reshape(-1, DIMENSIONS)
        known = [[(w, t, x) for w, t, x in zip(*(c[a:z].tolist() for c in (codes, often, each)), strict=True) if x == x] for a, z in zip(ends, ends[1:], strict=False)]  # not NaN
        near, lexical, smallest = Found(len(vectors), dense_k), Found(len(vectors), bm25_k), []
        for p in _parts(folder):
            if dense_k:
                near.start_part(p["ids"])
                _near(near, vectors, p["counts"])
            if bm25_k:
                lexical.start_part(p["ids"])
                _lexical(lexical, known, words, p, avgdl)
                smallest = sorted([*smallest, *p["ids"].take(pc.sort_indices(p["ids"])[:bm25_k]).to_pylist()])[:bm25_k]
        both = [(True, near, *near.settle()), (False, lexical, *lexical.settle())]
        shares = [np.zeros(len(rows)) for _, _, rows, _ in both]
        first = 0
        for p in _parts(folder):
            number = pc.index_in(words, p["vocabulary"]).fill_null(-1).to_numpy()[codes] if len(codes) else codes
            for share, (_, _, rows, at) in zip(shares, both, strict=True):
                here = np.flatnonzero((at >= first) & (at < first + len(p["dl"])))
                share[here] = _held(number, ends, rows[here], at[here] - first, p) / np.maximum(np.diff(ends)[rows[here]], 1)
            first += len(p["dl"])
        qids, out = table.column("qid").to_pylist(), []
        for share, (is_dense, found, _, _) in zip(shares, both, strict=True):
            seen = 0
            for q, qid in enumerate(qids if found.k else ()):
                best = found.best(q)
                best = [(i, s, o) for (i, s), o in zip(best, share[seen : seen + len(best)].tolist(), strict=True)]
                seen += len(best)
                if not is_dense and len(best) < bm25_k:  # all passages that share a word are there
                    has = {i for i, _, _ in best}
                    best = sorted([*best, *((i, 0.0, 0.0) for i in smallest if i not in has)], key=lambda x: (-x[1], x[0]))[:bm25_k]
                out.extend((qid, is_dense, i, s, r, o) for r, (i, s, o) in enumerate(best, 1))
                if out and (len(out) >= 100_000 or q == len(qids) - 1):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.bool_(), pa.string(), pa.float64(), pa.int32(), pa.float64()), strict=True)], ["qid", "is_dense", "chunk_id", "score", "rank", "overlap"])
                    out = []

    return asked.repartition(blocks).mapInArrow(run, "qid string, is_dense boolean, chunk_id string, score double, rank int, overlap double")
