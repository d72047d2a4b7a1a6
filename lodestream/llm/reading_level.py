"""Reading level of every document by harmonic propagation on the document-word graph.

Documents and the words of their prose are the two sides of a graph, an edge weighing sqrt(count) x idf. Documents
that readers graded are clamped to their mean grade; every other node takes the weighted mean of its neighbours,
again and again until the words' values stand still. The value that a document's words give it, graded or not, is
then mapped to the scale of the grades by a monotone regression on the graded documents.

Scale: one pass over the texts writes the graph (word buckets and counts of each document); each iteration is one
narrow pass over that table, which sums per task before one small shuffle. The words' values are a vector of
BUCKETS numbers, whatever the corpus; that is all that is sent to the tasks and back. No edge is ever shuffled.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.runtime import staged

#: Words are hashed to this many buckets; the bound of what the driver and each task hold.
BUCKETS = 1 << 18
#: Words in fewer documents tell nothing about others.
LEAST_DOCUMENTS = 3
#: Iterations end when no word's value moves by more than TOLERANCE; if MOST_ITERATIONS don't get there, it is an error.
TOLERANCE, MOST_ITERATIONS = 0.01, 1000
#: Pull of a word's first value towards the mean grade, in edge weights.
PRIOR = 2.0
#: Resolution of the calibration.
BINS = 400
#: Least share of function words in English prose.
LEAST_FUNCTION_WORDS = 0.12
#: A line of prose has at least so many words.
LEAST_LINE = 9
#: Lines are wrapped at some width up to this one, and a wrapped line has at least so many characters.
WRAP_WIDTH, LEAST_WRAPPED = 120, 40

# English function words that are no common words of other languages in Latin script.
FUNCTION_WORDS = frozenset(
    "the of and to is was it for with as at by from that this which its our each we he she they you their his her has have had been are were not but then while when because "
    "although near during after before without within across through would could should about into than these those there what who will your my if be or".split()
)

_LIST = re.compile(r"^(?:[•*\-–—·▪◦‣]|\d{1,3}[.)]|[a-z][.)])\s")
_HEADING = re.compile(r"^(?:#{1,6}\s|<h\d)", re.I)
_TAG = re.compile(r"</?[a-zA-Z][^<>]{0,200}>")
_LINK = re.compile(r"\S*(?:https?://|www\.)\S*")
_CODE = re.compile(r"[{}=\\]|^\s*(?:select|if|for|while|def|return|import)\b.*[:;)]$|\(\)")
_END = re.compile(r"[.!?;…]['\"”’)\]]*$")
_WORD = re.compile(r"(?<![^\W\d_])(?<!['’\-])[^\W\d_A-ZÀ-Þ]+(?:['’\-][^\W\d_]+)*")
_LETTERS = re.compile(r"[^\W\d_]")

GRAPH = "doc_id long, n_words int, english boolean, buckets array<int>, counts array<int>"


def unwrapped(lines: list[str]) -> list[str]:
    """Lines of one block, each wrapped line joined to the next: one that ends no sentence and to which the next line's
    first word couldn't be added within the block's width."""
    width = max(map(len, lines), default=0)
    if len(lines) < 2 or width > WRAP_WIDTH:
        return lines
    out, last = [lines[0]], lines[0]
    for line in lines[1:]:
        if len(last) >= LEAST_WRAPPED and not _END.search(last) and len(last) + 1 + len(line.split(" ", 1)[0]) > width:
            out[-1] += " " + line
        else:
            out.append(line)
        last = line
    return out


def prose_lines(text: str) -> list[str]:
    """Lines of running text, wrapped ones joined: no list items, headings, code, links or footers; short or unfinished
    lines are none. A fence that isn't closed fences nothing."""
    blocks: list[list[str]] = [[]]
    lines = [raw.strip() for raw in text.split("\n")]
    fences = sum(line.startswith("```") for line in lines) if "```" in text else 0
    met = 0
    for line in lines:
        if line.startswith("```"):
            met += 1
            blocks.append([])
        elif not line or (met % 2 and met < fences) or _LIST.match(line) or _HEADING.match(line):
            blocks.append([])
        else:
            blocks[-1].append(line)
    out = []
    for line in (x for block in blocks if block for x in unwrapped(block)):
        if "<" in line:
            line = _TAG.sub(" ", line)
        if "://" in line or "www." in line:
            line = _LINK.sub(" ", line).strip()
        if line.count(" ") < LEAST_LINE - 1 or not _END.search(line.rstrip()) or line.count("|") > 1 or _CODE.search(line):
            continue
        if len(line.split()) >= LEAST_LINE:
            out.append(line)
    return out


def prose_words(text: str) -> list[str]:
    """Words of the prose in lower case; capitalised words are names or begin a sentence and are left out."""
    prose = "\n".join(prose_lines(text))
    if prose and sum(map(str.isupper, prose)) * 2 > len(_LETTERS.findall(prose)):
        prose = prose.lower()
    return _WORD.findall(prose)


_BUCKET: dict[str, int] = {}


def bucket(word: str) -> int:
    known = _BUCKET.get(word)
    if known is None:
        if len(_BUCKET) > 500_000:
            _BUCKET.clear()
        known = _BUCKET[word] = zlib.crc32(word.encode("utf-8", "replace")) % BUCKETS
    return known


def read_document(text: str | None) -> tuple[int, bool, list[int], list[int]]:
    """(blank-separated words of the whole text, whether its prose is English, word buckets, counts)."""
    if not text:
        return 0, False, [], []
    words = Counter(prose_words(text))
    total = sum(words.values())
    english = total > 0 and sum(n for w, n in words.items() if w in FUNCTION_WORDS) >= LEAST_FUNCTION_WORDS * total
    if not english:
        return len(text.split()), False, [], []
    merged: Counter = Counter()
    for w, n in words.items():
        merged[bucket(w)] += n
    return len(text.split()), True, list(merged.keys()), list(merged.values())


def document_graph(documents: DataFrame) -> DataFrame:
    """doc_id, n_words, english, buckets, counts of every document; empty lists where there is no English prose."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [read_document(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.bool_()), pa.array([r[2] for r in rows], pa.list_(pa.int32())), pa.array([r[3] for r in rows], pa.list_(pa.int32()))],
                names=["doc_id", "n_words", "english", "buckets", "counts"],
            )

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, GRAPH)


def mean_grades(labels: DataFrame) -> DataFrame:
    """doc_id, grade: the mean of the readers' grades; rows without a grade don't count."""
    return labels.filter(F.col("grade").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg("grade").alias("grade"))


def _edges(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of each edge, bucket, sqrt of the count)."""
    lists = batch.column(batch.schema.get_field_index("buckets"))
    sizes = np.diff(lists.offsets.to_numpy(zero_copy_only=False))
    counts = batch.column(batch.schema.get_field_index("counts"))
    return np.repeat(np.arange(batch.num_rows), sizes), lists.flatten().to_numpy(zero_copy_only=False), np.sqrt(counts.flatten().to_numpy(zero_copy_only=False).astype(np.float64))


def _grades(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(batch.schema.get_field_index("grade")).to_numpy(zero_copy_only=False).astype(np.float64)


def _sparse(names: list[str], *vectors: np.ndarray) -> Iterator[pa.RecordBatch]:
    at = np.flatnonzero(np.any([v != 0 for v in vectors], axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *[pa.array(v[at]) for v in vectors]], names=["b", *names])


def _summed(parts: DataFrame, names: list[str]) -> list[np.ndarray]:
    """The per-task vectors added up: at most BUCKETS rows."""
    table = parts.groupBy("b").agg(*[F.sum(n).alias(n) for n in names]).toArrow()
    at = table.column("b").to_numpy()
    out = []
    for n in names:
        v = np.zeros(BUCKETS)
        v[at] = table.column(n).to_numpy()
        out.append(v)
    return out


def _document_values(batch: pa.RecordBatch, weight: np.ndarray, value: np.ndarray) -> np.ndarray:
    row, b, root = _edges(batch)
    w = root * weight[b]
    n = batch.num_rows
    total = np.bincount(row, w, n)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(total > 0, np.bincount(row, w * value[b], n) / total, np.nan)


def propagate(graph: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(weight, value) of each bucket when the iterations have come to rest. ``graph`` has the column grade too."""
    names = ["df", "num", "den"]

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, num, den = (np.zeros(BUCKETS) for _ in range(3))
        for batch in batches:
            row, b, root = _edges(batch)
            df += np.bincount(b, minlength=BUCKETS)
            g = _grades(batch)[row]
            known = ~np.isnan(g)
            num += np.bincount(b[known], (root * g)[known], BUCKETS)
            den += np.bincount(b[known], root[known], BUCKETS)
        yield from _sparse(names, df, num, den)

    english = graph.filter("english").select("buckets", "counts", "grade")
    totals = english.agg(F.count(F.lit(1)).alias("n"), F.avg("grade").alias("mean")).first()
    n, mean = totals["n"], totals["mean"]
    if not n or mean is None:
        return np.zeros(BUCKETS), np.zeros(BUCKETS)
    df, num, den = _summed(english.mapInArrow(start, "b int, df double, num double, den double"), names)
    weight = np.where(df >= LEAST_DOCUMENTS, np.log(np.maximum(n, 2) / np.maximum(df, 1)), 0.0)
    value = (num + PRIOR * mean) / (den + PRIOR)

    for _ in range(MOST_ITERATIONS):

        def step(batches: Iterator[pa.RecordBatch], value=value) -> Iterator[pa.RecordBatch]:
            num, den = np.zeros(BUCKETS), np.zeros(BUCKETS)
            for batch in batches:
                s = _document_values(batch, weight, value)
                g = _grades(batch)
                s = np.where(np.isnan(g), s, g)  # graded documents are clamped
                row, b, root = _edges(batch)
                known = ~np.isnan(s[row])
                num += np.bincount(b[known], (root * s[row])[known], BUCKETS)
                den += np.bincount(b[known], root[known], BUCKETS)
            yield from _sparse(["num", "den"], num, den)

        num, den = _summed(english.mapInArrow(step, "b int, num double, den double"), ["num", "den"])
        new = np.where(den > 0, num / np.maximum(den, 1e-12), mean)
        moved = float(np.abs((new - value)[weight > 0]).max(initial=0.0))
        value = new
        if moved <= TOLERANCE:
            return weight, value
    raise RuntimeError(f"words still move by {moved:.4g} after {MOST_ITERATIONS} iterations")


def monotone_fit(cells: list[tuple[float, float, float]]) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression of (x, mean y, weight) cells by pooling; the knots of a piecewise linear map."""
    blocks: list[list[float]] = []
    for x, y, w in sorted(cells):
        blocks.append([x * w, y * w, w])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def reading_levels(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, n_words, english, level of every document; ``level`` is on the scale of the grades, 1 easiest.

    ``documents``: doc_id, text; ``labels``: doc_id, grade (several rows a document are averaged; null grades and
    labels of unknown documents don't count). Level is null where a document has no English prose (null and empty
    texts included), where none of its words is found in other documents, and everywhere if there is no grade.
    Language is judged by the text only. Lists, headings, names, code, links and footers have no part in the
    level. Texts of any length are read whole. Repeated rows are rated alike. Other columns are ignored.
    """
    graph = staged(document_graph(documents).join(mean_grades(labels), "doc_id", "left"), "reading-graph")
    weight, value = propagate(graph)
    lo, hi = (float(v) for v in (value[weight > 0].min(initial=9.0), value[weight > 0].max(initial=0.0)))

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = _document_values(batch, weight, value)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(s, from_pandas=True), batch.column(batch.schema.get_field_index("grade"))], names=["doc_id", "n_words", "english", "raw", "grade"])

    rated = graph.select("doc_id", "n_words", "english", "buckets", "counts", "grade").mapInArrow(rate, "doc_id long, n_words int, english boolean, raw double, grade double")
    if hi <= lo:
        return rated.select("doc_id", "n_words", "english", F.lit(None).cast("double").alias("level"))
    rated = staged(rated, "reading-raw")
    cell = F.floor((F.col("raw") - lo) / (hi - lo) * BINS)
    known = rated.filter(F.col("grade").isNotNull() & F.col("raw").isNotNull()).groupBy(cell.alias("c")).agg(F.avg("raw").alias("x"), F.avg("grade").alias("y"), F.count(F.lit(1)).alias("w"))
    xs, ys = monotone_fit([(r["x"], r["y"], float(r["w"])) for r in known.collect()])  # at most BINS + 1 rows

    @F.pandas_udf("double")
    def on_scale(raw):
        return raw.map(lambda v: float(np.interp(v, xs, ys)), na_action="ignore") if len(xs) else raw * np.nan

    return rated.select("doc_id", "n_words", "english", F.round(on_scale("raw"), 4).alias("level"))


def demanding_documents(levels: DataFrame, least_level: float = 3.5, least_words: int = 80) -> DataFrame:
    """doc_id of the English documents of at least ``least_words`` words whose prose rounds to grade 4 or 5."""
    return levels.filter(F.col("english") & (F.col("n_words") >= least_words) & (F.col("level") >= least_level)).select("doc_id").distinct()


def level_profile(levels: DataFrame) -> DataFrame:
    """Documents and words per whole level of the corpus; level null where there is none."""
    return levels.groupBy(F.round("level", 0).cast("int").alias("level")).agg(F.count(F.lit(1)).alias("n_documents"), F.sum(F.col("n_words").cast("long")).alias("n_words"))
