"""Quality classifier by co-training of two views.

One classifier sees the text's content (how kinds of characters follow each
other, its words), the other nothing but the document's metadata (language,
source, stated length).  Over some rounds each scores all unlabelled documents
and labels those it is surest of for the other.  Both are calibrated on
labelled documents that neither was fitted on, and their log-odds are added to
score every document.

The labelled documents that are fitted on are at most ``max_labelled``, those
with the smallest hashed ids.  All else covers every document and whole texts:
features are taken once and kept in the shared folder, and a round passes over
all of them.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideweave.llm.batches import arrow_map, binaries, sliced
from tideweave.plans.lineage import stash

MAX_LABELLED = 6000
ROUNDS = 4
PER_ROUND = 200
THRESHOLD = 0.5
#: Kinds of bytes: lower, upper, digit, space, newline, then single signs and the rest.
SIGNS = b".,!?%#&$*|"
KINDS = bytes(
    0 if 97 <= b <= 122 else 1 if 65 <= b <= 90 else 2 if 48 <= b <= 57 else 3 if b in (9, 32)
    else 4 if b in (10, 13) else 5 + SIGNS.index(b) if b in SIGNS else 15 if b < 128 else 0
    for b in range(256)
)
N_KINDS = 16
N_CONTENT = N_KINDS * N_KINDS + 3
N_LANGS, N_SOURCES, N_SIZES = 16, 64, 24
CHUNK = 1 << 20
#: Log-odds of what counts as sure: 9 to 1.
SURE = 2.2
#: Partitions that the last choice among all documents runs in.
LAST_PARTS = 8


# -------------------------------------------------------------------- features
def content_features(raw: bytes) -> np.ndarray:
    """Roots of the shares of kind pairs, and statistics of the words."""
    counts = np.zeros(N_KINDS * N_KINDS)
    for at in range(0, len(raw), CHUNK):
        kinds = np.frombuffer(raw[at : at + CHUNK + 1].translate(KINDS), np.uint8).astype(np.intp)
        if len(kinds) > 1:
            counts += np.bincount(kinds[:-1] * N_KINDS + kinds[1:], minlength=N_KINDS * N_KINDS)
    words = raw.split()
    n = max(1, len(words))
    stats = [len(set(words)) / n, np.log1p(len(words)) / 10, np.log1p(len(raw) / n) / 5]
    return np.concatenate([np.sqrt(counts / max(1.0, counts.sum())), stats])


def metadata_codes(lang: str | None, source: str | None, n_chars: int | None) -> tuple[int, int, float]:
    """Hashed language and source, and the logarithm of the stated length (-1 if null)."""
    size = -1.0 if n_chars is None else float(np.log2(1 + max(0, n_chars)))
    return zlib.crc32((lang or "").encode()) % N_LANGS, zlib.crc32((source or "").encode()) % N_SOURCES, size


def metadata_features(codes: np.ndarray) -> np.ndarray:
    """Codes, a row each, as indicators of language, source and range of length, and the length."""
    n = len(codes)
    out = np.zeros((n, N_LANGS + N_SOURCES + N_SIZES + 1))
    rows = np.arange(n)
    size = codes[:, 2]
    out[rows, codes[:, 0].astype(int)] = 1
    out[rows, N_LANGS + codes[:, 1].astype(int)] = 1
    out[rows, N_LANGS + N_SOURCES + np.clip(size.astype(int) + 1, 0, N_SIZES - 1)] = 1
    out[:, -1] = size / 20
    return out


# ----------------------------------------------------------------- classifiers
@dataclass
class Logistic:
    """Logistic regression with a ridge, by Newton's method."""

    weights: np.ndarray
    bias: float

    @classmethod
    def fit(
        cls,
        x: np.ndarray,
        y: np.ndarray,
        ridge: float = 1e-3,
        steps: int = 12,
        toward: np.ndarray | None = None,
        sample: np.ndarray | None = None,
    ) -> Logistic:
        """``toward``: the weights that the ridge draws to; ``sample``: the rows' weights."""
        a = np.hstack([x, np.ones((len(x), 1))])
        mean = np.zeros(a.shape[1])
        if toward is not None:
            mean[:-1] = toward
        w = mean.copy()
        each = np.ones(len(x)) if sample is None else sample
        penalty = np.full(len(w), ridge * len(x))
        penalty[-1] = 1e-6
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            grad = a.T @ (each * (p - y)) + penalty * (w - mean)
            hess = (a * (each * (p * (1 - p) + 1e-6))[:, None]).T @ a + np.diag(penalty)
            move = np.linalg.solve(hess, grad)
            w -= move
            if np.abs(move).max() < 1e-6:
                break
        return cls(w[:-1], float(w[-1]))

    def odds(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights + self.bias


@dataclass
class CoTrained:
    """Two calibrated views; without labels of both classes it keeps everything."""

    content: Logistic | None = None
    metadata: Logistic | None = None
    scales: list[tuple[float, float]] = field(default_factory=list)
    prior: float = 0.0
    exchanged: int = 0

    def score(self, content: np.ndarray, metadata: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated probabilities of quality: by content, by metadata, combined."""
        if self.content is None or self.metadata is None:
            one = np.ones(len(content))
            return one, one, one
        views = [
            a * model.odds(x) + b
            for (a, b), model, x in zip(self.scales, (self.content, self.metadata), (content, metadata), strict=True)
        ]
        both = views[0] + views[1] - self.prior
        return tuple(1 / (1 + np.exp(-np.clip(v, -30, 30))) for v in (*views, both))


#: Of each view the surest documents: their key, features (content, codes) and label.
Picks = list[list[tuple[int, np.ndarray, float]]]


def surest(
    models: list[Logistic], keys: np.ndarray, x: np.ndarray, quota: tuple[int, int], taken: frozenset[int]
) -> Picks:
    """Of each view the ``quota`` surest rows of either class, one row per key."""
    out: Picks = []
    keys, at = np.unique(keys, return_index=True)
    free = np.array([k not in taken for k in keys.tolist()], bool)
    keys, x = keys[free], x[at[free]]
    views = (x[:, :N_CONTENT], metadata_features(x[:, N_CONTENT:])) if len(x) else ([], [])
    for model, view in zip(models, views, strict=True):
        picked = []
        if len(x):
            odds = np.round(model.odds(view), 9)  # alike in whatever batch a row stands
            for label, order, n in ((0.0, odds, quota[0]), (1.0, -odds, quota[1])):
                best = np.lexsort((keys, order))[:n]
                picked += [(int(keys[i]), x[i], label) for i in best.tolist() if order[i] < -SURE]
        out.append(picked)
    return out


def co_train(
    x: np.ndarray,
    y: np.ndarray,
    pool: Callable[[list[Logistic], tuple[int, int], frozenset[int]], Picks],
    rounds: int = ROUNDS,
    per_round: int = PER_ROUND,
) -> CoTrained:
    """Fit both views on rows of content features and metadata codes.

    Every fourth labelled row is left for calibration.  ``pool`` gives each
    view's surest unlabelled documents, as :func:`surest` does.
    """
    if len(set(y.tolist())) < 2 or min(np.bincount(y.astype(int), minlength=2)) < 8:
        return CoTrained()
    held = np.zeros(len(y), bool)
    for k in (0, 1):  # of both classes
        held[np.flatnonzero(y == k)[::4]] = True
    share = y.mean()
    split = lambda rows: (rows[:, :N_CONTENT], metadata_features(rows[:, N_CONTENT:]))
    views = split(x)
    extra: Picks = [[], []]

    def fit(v: int) -> Logistic:
        more = [split(np.array([row for _, row, _ in extra[v]]))[v]] if extra[v] else []
        return Logistic.fit(
            np.vstack([views[v][~held], *more]), np.concatenate([y[~held], [label for _, _, label in extra[v]]])
        )

    models = [fit(0), fit(1)]
    quota = max(1, round(per_round * (1 - share))), max(1, round(per_round * share))
    taken: set[int] = set()
    exchanged = 0
    for _ in range(rounds):
        picks = pool(models, quota, frozenset(taken))
        for v in (0, 1):
            extra[1 - v] += picks[v]
            taken.update(k for k, _, _ in picks[v])
            exchanged += len(picks[v])
        if not any(picks):
            break
        models = [fit(0), fit(1)]
    scales = []
    for model, view in zip(models, views, strict=True):
        line = Logistic.fit(model.odds(view[held])[:, None], y[held], ridge=1e-4)
        scales.append((float(line.weights[0]), line.bias))
    prior = float(np.log(share / (1 - share)))
    return CoTrained(models[0], models[1], scales, prior, exchanged)


# --------------------------------------------------------------------- operator
TEXT = ["text", "lang", "source", "n_chars"]


def features(part: pa.RecordBatch, at: int) -> np.ndarray:
    """Content features and metadata codes of a batch with :data:`TEXT` from column ``at`` on."""
    raws = binaries(part.column(at))
    meta = zip(*(part.column(at + k).to_pylist() for k in (1, 2, 3)), strict=True)
    return np.hstack([np.array([content_features(r) for r in raws]), np.array([metadata_codes(*m) for m in meta])])


def _inputs(df: DataFrame) -> list:
    kinds = {"text": "string", "lang": "string", "source": "string", "n_chars": "long"}
    have = {c.lower(): c for c in df.columns}
    return [
        (F.col(f"`{have[c]}`") if c in have else F.lit(None)).cast(kinds[c]).alias(f"__{c}") for c in TEXT
    ]


def _stored(docs: DataFrame, known: DataFrame, id_col: str) -> DataFrame:
    """``(id, y, key, x)`` of every document with an id; ``y`` is null if unlabelled.

    ``x`` holds the features as 16-bit floats, ``key`` is a hash of it: copies
    of a document have the same key.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, column=1):
            rows = [r.tobytes() for r in features(part, 1).astype(np.float16)]
            keys = [xxhash.xxh64_intdigest(r, 3) >> 1 for r in rows]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(keys, pa.int64()), pa.array(rows, pa.binary())], names=["id", "key", "x"]
            )

    kind = docs.schema[id_col].dataType.simpleString()
    kept = docs.select(F.col(f"`{id_col}`").alias("id"), *_inputs(docs)).where("id is not null")
    return stash(arrow_map(kept, run, f"id {kind}, key long, x binary").join(known, "id", "left"), "quality-features")


def _matrix(rows: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(rows), np.float16).reshape(len(rows), -1).astype(np.float64)


def _pool(free: DataFrame) -> Callable[[list[Logistic], tuple[int, int], frozenset[int]], Picks]:
    """:func:`surest` over all rows of ``(key, x)``, chosen in tasks, then among their choices."""
    schema = "view int, label double, key long, x binary"
    names = ["view", "label", "key", "x"]

    def choose(models: list[Logistic], quota: tuple[int, int], taken: frozenset[int]) -> Picks:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, bytes] = {}
            picks: Picks = [[], []]
            for batch in batches:
                at = batch.schema.get_field_index("key")
                held.update(zip(batch.column(at).to_pylist(), batch.column(at + 1).to_pylist(), strict=True))
                if len(held) >= 8192:
                    picks = surest(models, np.array(list(held)), _matrix(list(held.values())), quota, taken)
                    held = {k: x.astype(np.float16).tobytes() for v in picks for k, x, _ in v}
            if held:
                picks = surest(models, np.array(list(held)), _matrix(list(held.values())), quota, taken)
            rows = [(v, y, k, x.astype(np.float16).tobytes()) for v in (0, 1) for k, x, y in picks[v]]
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.float64(), pa.int64(), pa.binary()), strict=True)],
                    names=names,
                )

        best = arrow_map(free.select("key", "x"), run, schema)
        best = arrow_map(best.repartition("key").select("key", "x"), run, schema)
        best = arrow_map(best.repartition(LAST_PARTS, "key").select("key", "x"), run, schema)
        # At most LAST_PARTS times the quota of rows.
        got = {r["key"]: r["x"] for r in best.select("key", "x").collect()}
        if not got:
            return [[], []]
        return surest(models, np.array(list(got), np.int64), _matrix(list(got.values())), quota, taken)

    return choose


def fit_quality(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    label_col: str = "quality",
    max_labelled: int = MAX_LABELLED,
) -> CoTrained:
    """Fit on the bounded sample of labelled documents and on all unlabelled ones.

    Rows without an id or a 0/1 label are not used; of rows that share an id
    with a label one is.
    """
    known = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("y"))
    known = known.where(F.col("id").isNotNull() & F.col("y").isin(0, 1)).groupBy("id").agg(F.min("y").alias("y"))
    stored = _stored(docs, known, id_col)
    # The ids are chosen first, as every task sends what it would choose to the driver.
    chosen = F.broadcast(known.select("id").orderBy(F.xxhash64("id"), "id").limit(max_labelled))
    one = stored.join(chosen, "id", "left_semi").groupBy("id", "y").agg(F.min(F.struct("key", "x")).alias("r"))
    got = one.select("id", "y", "r.x").toPandas()
    if not len(got):
        return CoTrained()
    got = got.sort_values(["id"], kind="stable")
    y = got["y"].to_numpy().astype(float)
    return co_train(_matrix(list(got["x"])), y, _pool(stored.where("y is null")))


def score_quality(
    docs: DataFrame, model: CoTrained, keep: list[str], threshold: float = THRESHOLD, prefix: str = ""
) -> DataFrame:
    """``keep`` with ``p_content``, ``p_metadata``, ``score`` and ``accepted``.

    ``prefix`` stands before these four names, for tables that have columns
    named like them.
    """
    fields = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = ", ".join(f"`{c}` {fields[c]}" for c in keep)
    n = len(keep)
    names = [prefix + c for c in ("p_content", "p_metadata", "score", "accepted")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, column=n):
            x = features(part, n)
            views = model.score(x[:, :N_CONTENT], metadata_features(x[:, N_CONTENT:]))
            columns = [*part.columns[:n], *(pa.array(v, pa.float64()) for v in views)]
            columns.append(pa.array(views[2] >= threshold, pa.bool_()))
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, *names])

    picked = docs.select(*(F.col(f"`{c}`") for c in keep), *_inputs(docs))
    added = ", ".join(f"`{c}` {kind}" for c, kind in zip(names, ("double", "double", "double", "boolean"), strict=True))
    return arrow_map(picked, run, f"{schema}, {added}")


def quality_scores(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality"
) -> DataFrame:
    """``(<id_col>, p_content, p_metadata, score, accepted)``, one row per row of ``docs``.

    Null text counts as empty, null or missing metadata as a value of its own.
    Without at least eight labelled documents of either class every document is
    accepted with score 1.  Repeated rows and null ids pass through; an empty
    table gives an empty result; further columns of ``docs`` are not read.
    """
    return score_quality(docs, fit_quality(docs, labels, id_col, label_col), [id_col])


def op10_quality_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return quality_scores(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES = {"op10_quality_cotraining": op10_quality_cotraining}
ORACLES: dict[str, str] = {}
