"""Toxicity: a support vector machine with a gap-weighted subsequence kernel and Nyström landmarks.

Units are tokens reduced to their letters (look-alike digits and signs read as letters, other signs dropped), runs of lone
letters joined, in windows of at most 12 letters. The kernel of two units sums, over all subsequences of three letters that
both hold, LAMBDA to the power of both spans; a gapped or stuffed insult keeps most of its
subsequences. Kernel values are scaled by a function of the units' lengths, which keeps the kernel positive semidefinite.

Training sees labelled texts as bags of units: all units of a clean text are clean, a toxic text has at
least one toxic unit. Positives start from letter 4-grams that toxic texts hold and clean ones don't, and are chosen anew by the
machine in each round, as are hard negatives. Landmarks are units of either side; the machine is linear in the Nyström
features. As its decision is a weighted sum of kernel values to the landmarks, it folds exactly into one weight for each
subsequence (32,768 numbers), so scoring a unit costs no kernel evaluation. A text's score is the logistic of its highest unit.

Training takes at most ``max_rows`` labelled rows of each class, those with the least hash of the id; their whole texts are
reduced to distinct units on the executors, and the machine is trained in one task, which meets no more than these rows; the
driver gets its weights. A round of training takes TRAIN_UNITS positives at most, those of the most texts, and as
many of the hardest and of randomly drawn negatives. Every text is scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridstone.llm.common import by_batches, columns
from gridstone.llm.textarrays import NOT_SPACE, blocks, spans

LAMBDA, LETTERS, STRIDE = 0.7, 12, 4
LANDMARKS = 240
#: Labelled rows of a class that training takes at most; units of a side that a round of training takes at most.
MAX_ROWS, TRAIN_UNITS = 3000, 2500
#: Weight of the squared norm beside losses that weigh 1,000 in all.
PENALTY = 1e-3
#: Log odds from which on a unit is a seed.
SEED_ODDS = 2.0
#: A clean text over the threshold counts as so many toxic ones under it, as shares of their classes.
ALARM = 20

#: Where a cut lies between two values.
CUT = 0.4

#: Byte to letter: 1-26 for a-z, 27-31 for bytes beyond ASCII, 0 for what is dropped.
LETTER = np.zeros(256, np.uint8)
for _c in range(26):
    LETTER[[ord("a") + _c, ord("A") + _c]] = _c + 1
for _a, _b in zip("013457@$!", "oieastasi"):
    LETTER[ord(_a)] = ord(_b) - 96
LETTER[0xA0:0xC0] = 27 + np.arange(32) % 5  # second bytes; first ones say little and are dropped
LETTER[0x80:0xA0] = 27 + np.arange(32) % 5

_TRIPLES = {n: np.array(list(combinations(range(n), 3))) for n in range(3, LETTERS + 1)}
_WEIGHT = {n: LAMBDA ** (t[:, 2] - t[:, 0] + 1.0) for n, t in _TRIPLES.items()}
_NORM = {n: float(np.sqrt((w ** 2).sum())) for n, w in _WEIGHT.items()}


def units(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed units (5 bits a letter) of a block of texts, and the text that each is of."""
    starts, ends, _ = spans(data, offs, NOT_SPACE)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    code = LETTER[data]
    held = np.append(0, np.cumsum(code > 0))
    letters = code[code > 0].astype(np.uint64)
    a, b = held[starts], held[ends]
    owner = np.searchsorted(offs, starts, side="right") - 1
    n = b - a
    # three lone letters or more in a row are one unit
    lone = n == 1
    same = np.append(False, lone[1:] & lone[:-1] & (owner[1:] == owner[:-1]))
    opens = np.flatnonzero(lone & ~same)
    closes = np.flatnonzero(lone & ~np.append(same[1:], False))
    run = b[closes] - a[opens] >= 3
    a, b, owner = np.concatenate([a, a[opens][run]]), np.concatenate([b, b[closes][run]]), np.concatenate([owner, owner[opens][run]])
    n = b - a
    short = (n >= 3) & (n <= LETTERS)
    wide = np.flatnonzero(n > LETTERS)
    count = -(-(n[wide] - LETTERS) // STRIDE) + 1
    step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    at = np.minimum(np.repeat(a[wide], count) + step * STRIDE, np.repeat(b[wide], count) - LETTERS)
    a = np.concatenate([a[short], at])
    n = np.concatenate([n[short], np.full(len(at), LETTERS)])
    owner = np.concatenate([owner[short], np.repeat(owner[wide], count)])
    packed = np.zeros(len(a), np.uint64)
    padded = np.append(letters, np.zeros(LETTERS, np.uint64))
    for i in range(LETTERS):
        packed |= np.where(i < n, padded[a + i], np.uint64(0)) << np.uint64(5 * i)
    return packed, owner


def unpacked(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letters (units x LETTERS) and lengths."""
    c = np.stack([((packed >> np.uint64(5 * i)) & np.uint64(31)).astype(np.int32) for i in range(LETTERS)], axis=1)
    return c, (c > 0).sum(axis=1)


def _features(c: np.ndarray, n: int) -> np.ndarray:
    """Numbers of the subsequences of units of length n (subsequences x units)."""
    t = _TRIPLES[n]
    return (c[:, t[:, 0]] << 10 | c[:, t[:, 1]] << 5 | c[:, t[:, 2]]).T


def decide(packed: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Decision values of units; the last weight is the bias."""
    out = np.zeros(len(packed))
    for lo in range(0, len(packed), 1 << 16):
        c, n = unpacked(packed[lo:lo + (1 << 16)])
        for k in np.unique(n):
            at = np.flatnonzero(n == k)
            for i in range(0, len(at), 1 << 13):
                part = at[i:i + (1 << 13)]
                out[lo + part] = _WEIGHT[k] @ weights[_features(c[part], k)] / _NORM[k]
    return out + weights[-1]


def phi(packed: np.ndarray) -> np.ndarray:
    """Explicit features (units x 32,768), scaled by length; for landmarks."""
    c, n = unpacked(packed)
    out = np.zeros((len(packed), 1 << 15), np.float32)
    for i in range(len(packed)):
        np.add.at(out[i], _features(c[i:i + 1], n[i])[:, 0], _WEIGHT[n[i]] / _NORM[n[i]])
    return out


def kernel(packed: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Kernel values of units and landmarks, the latter as features."""
    c, n = unpacked(packed)
    out = np.zeros((len(packed), len(marks)), np.float32)
    columns = np.ascontiguousarray(marks.T, dtype=np.float32)
    for k in np.unique(n):
        at = np.flatnonzero(n == k)
        weight = (_WEIGHT[k] / _NORM[k]).astype(np.float32)
        for lo in range(0, len(at), 500):  # what is summed stays in the cache
            part = at[lo:lo + 500]
            held = np.zeros((len(part), len(marks)), np.float32)
            row = np.empty_like(held)
            for w, u in zip(weight, _features(c[part], k)):
                np.take(columns, u, axis=0, out=row)
                row *= w
                held += row
            out[part] = held
    return out


def _machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = PENALTY, steps: int = 400) -> np.ndarray:
    """Linear machine with squared hinge loss by accelerated gradient descent; the last weight is the bias."""
    x = np.hstack([x, np.ones((len(x), 1))])
    v = z = np.zeros(x.shape[1])
    rate = 1.0 / (2 * np.linalg.eigvalsh(x.T @ (x * weight[:, None]))[-1] + penalty)
    for i in range(steps):
        gap = np.maximum(0, 1 - y * (x @ z))
        g = -2 * (x.T @ (weight * y * gap)) + penalty * np.append(z[:-1], 0)
        last, v = v, z - rate * g
        z = v + i / (i + 3) * (v - last)
    return v


def _bag_top(score: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    top = np.full(n, -1.0)
    if len(owner):
        np.maximum.at(top, owner, score)
    return top


def _odds(kinds: np.ndarray, at: np.ndarray, owner: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log odds of the letter 4-gram of each unit that tells toxic texts best, and a lower bound of it that few texts can't make large."""
    grams = [((kinds >> np.uint64(5 * i)) & np.uint64(0xFFFFF)).astype(np.int32) for i in range(LETTERS - 3)]
    whole = [g >> 15 > 0 for g in grams]
    t_df, c_df = np.zeros(1 << 20, np.int64), np.zeros(1 << 20, np.int64)
    ends = np.searchsorted(owner, np.arange(0, len(labels) + 200, 200))
    for lo, hi in zip(ends[:-1], ends[1:]):  # 200 texts at a time
        some, who = at[lo:hi], owner[lo:hi]
        who = who.astype(np.int64)
        seen = np.unique(np.concatenate([who[ok[some]] << 20 | g[some][ok[some]] for g, ok in zip(grams, whole)]))
        sick = labels[seen >> 20] > 0
        np.add.at(t_df, seen[sick] & 0xFFFFF, 1)
        np.add.at(c_df, seen[~sick] & 0xFFFFF, 1)
    n_t, n_c = (labels > 0).sum(), (labels == 0).sum()
    odds = np.log((t_df + 0.5) / (n_t + 1)) - np.log((c_df + 0.5) / (n_c + 1))
    sure = odds - 1.64 * np.sqrt(1 / (t_df + 0.5) + 1 / (c_df + 0.5))
    odds = np.where(t_df >= max(2, n_t // 300), odds, -9.0) + 0.3 * np.log1p(t_df)
    out = [np.full(len(kinds), -9.0), np.full(len(kinds), -9.0)]
    for g, ok in zip(grams, whole):
        out = [np.where(ok, np.maximum(best, x[g]), best) for best, x in zip(out, (odds, sure))]
    return out[0], out[1]


def train(packed: np.ndarray, owner: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, float, float]:
    """Weights of the subsequences and the bias, then slope and offset of the logistic. One class only: a constant score.

    ``packed`` has the units of all texts, ``owner`` the text that each is of, in ascending order. Every fourth text is held
    back first: of a machine that chooses its positives anew and one that takes sure units only, the one that tells these texts better is
    trained on all texts, and the logistic is the one fitted to the texts held back."""
    labels = np.asarray(labels)
    if not len(labels) or labels.min() == labels.max():
        share = float(labels.mean()) if len(labels) else 0.0
        return np.zeros((1 << 15) + 1), 0.0, 6.0 * (2 * share - 1)
    back = np.zeros(len(labels), bool)
    for y in (0, 1):
        back[np.flatnonzero(labels == y)[3::4]] = True
    if back.sum() in (0, labels[back].sum(), (labels[back] == 0).sum()) or not labels[~back].any():  # too few of a class
        kinds, at, owner = distinct(packed, owner)
        weights = machine(kinds, at, owner, labels, True)
        return weights, *_logistic(_bag_top(decide(kinds, weights)[at], owner, len(labels)), labels)[1:]
    whole = distinct(packed, owner)
    del packed, owner
    found, shown, kept = [], _some(*whole, ~back), _some(*whole, back)
    for sure in (False, True):
        weights = machine(*shown, labels[~back], sure)
        top = _bag_top(decide(kept[0], weights)[kept[1]], kept[2], int(back.sum()))
        found.append((*_logistic(top, labels[back]), sure))
    del shown, kept
    _, a, b, sure = max(found, key=lambda x: x[0])
    return machine(*whole, labels, sure), a, b


def distinct(packed: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct units in order, and of each distinct unit of a text its place among them and the text, by text and place, in four bytes each."""
    kinds = np.unique(packed)
    pair = owner.astype(np.int64)
    pair *= len(kinds)
    for lo in range(0, len(pair), 1 << 16):
        pair[lo:lo + (1 << 16)] += np.searchsorted(kinds, packed[lo:lo + (1 << 16)])
    pair.sort()
    pair = pair[np.append(True, pair[1:] != pair[:-1])[:len(pair)]]
    owner = (pair // max(1, len(kinds))).astype(np.int32)
    pair %= max(1, len(kinds))
    return kinds, pair.astype(np.int32), owner


def _some(kinds: np.ndarray, at: np.ndarray, owner: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What ``distinct`` gives of the units of some texts, those being counted anew."""
    held = texts[owner]
    at, owner = at[held], (np.cumsum(texts, dtype=np.int32) - 1)[owner[held]]
    used = np.zeros(len(kinds), bool)
    used[at] = True
    return kinds[used], (np.cumsum(used, dtype=np.int32) - 1)[at], owner


def machine(kinds: np.ndarray, at: np.ndarray, owner: np.ndarray, labels: np.ndarray, only_sure: bool, rounds: int = 3) -> np.ndarray:
    """Weights of the subsequences and the bias, from what ``distinct`` gives. ``only_sure``: the positives are the units that several toxic texts and hardly any clean ones hold, and no others."""
    weights, rng = np.zeros((1 << 15) + 1), np.random.default_rng(4)
    toxic = labels[owner] > 0
    n_t, n_c = int((labels > 0).sum()), int((labels == 0).sum())
    t_df, c_df = np.bincount(at[toxic], minlength=len(kinds)), np.bincount(at[~toxic], minlength=len(kinds))
    first, sure = _odds(kinds, at, owner, labels)
    seeds = np.flatnonzero(only_sure & (t_df >= max(2, n_t // 100)) & (t_df * n_c > 20 * c_df * n_t) & (sure > SEED_ODDS))
    clean_kinds = np.flatnonzero(c_df)
    at, owner = at[toxic], owner[toxic]  # positives are chosen from toxic texts
    del toxic
    score = first
    for r in range(rounds):
        s = score[at]
        top = _bag_top(s, owner, len(labels))
        chosen = (s >= top[owner] - 1.0) & (s > 0.5) if r == 0 else (s >= np.minimum(top[owner], 0.9)) & (s > -0.9)
        pos = seeds if only_sure and len(seeds) else np.unique(at[chosen])
        hard = np.setdiff1d(clean_kinds, seeds, assume_unique=True)
        hard = hard[np.argsort(-score[hard], kind="stable")][:TRAIN_UNITS]
        neg = np.setdiff1d(np.union1d(hard, rng.choice(clean_kinds, min(TRAIN_UNITS, len(clean_kinds)), replace=False)), seeds) if len(clean_kinds) else clean_kinds
        pos = np.setdiff1d(pos, neg if r == 0 else hard[:200])
        pos = pos[np.argsort(-t_df[pos], kind="stable")][:TRAIN_UNITS]
        if not len(pos) or not len(neg):
            break
        marks = np.concatenate([pos[:LANDMARKS // 2], hard[:LANDMARKS // 4], rng.choice(neg, min(LANDMARKS // 4, len(neg)), replace=False)])
        feats = phi(kinds[np.unique(marks)])
        values, vectors = np.linalg.eigh((feats @ feats.T).astype(float))
        keep = values > 1e-6 * values.max()
        root = vectors[:, keep] / np.sqrt(values[keep])
        rows = np.concatenate([pos, neg])
        y = np.append(np.ones(len(pos)), -np.ones(len(neg)))
        balance = np.append(np.full(len(pos), 0.5 / len(pos)), np.full(len(neg), 0.5 / len(neg)))
        v = _machine(kernel(kinds[rows], feats) @ root, y, balance * 1000)
        v = np.append(root @ v[:-1], v[-1])
        weights = np.concatenate([*(feats[:, lo:lo + (1 << 12)].T @ v[:-1] for lo in range(0, feats.shape[1], 1 << 12)), v[-1:]])  # a part at a time, as a product makes eight bytes of four
        del feats
        score = decide(kinds, weights)
    return weights


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Gain, slope and offset of a logistic that is 0.7 at the cut with the most toxic texts over it, a clean text over it weighing ALARM times as much.

    The cut lies between two values, nearer to the lower one, since gaps and further letters lower a score; the slope makes clean texts' median 0.05."""
    values = np.unique(x)
    cuts = np.append(values[:-1] + CUT * (values[1:] - values[:-1]), values[-1] + 1)
    toxic, clean = np.sort(x[y > 0]), np.sort(x[y == 0])
    gain = 1 - np.searchsorted(toxic, cuts) / len(toxic) - ALARM * (1 - np.searchsorted(clean, cuts) / len(clean))
    best = np.flatnonzero(gain >= gain.max() - 1e-9)
    cut = float(cuts[best[len(best) // 2]])
    slope = min(20.0, max(0.5, 3.79 / max(1e-3, cut - float(np.median(clean)))))
    return float(gain.max()), slope, 0.8473 - slope * cut


def texts_units(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct units of each text, and the text that each is of, in ascending order."""
    packed, owner = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for lo, _, data, offs in blocks(texts):
        u, o = units(data, offs)
        order = np.lexsort((u, o))
        u, o = u[order], o[order]
        new = np.append(True, (u[1:] != u[:-1]) | (o[1:] != o[:-1]))[:len(u)]
        packed.append(u[new])
        owner.append(o[new] + lo)
    return np.concatenate(packed), np.concatenate(owner)


def score_texts(texts: pa.Array, model: tuple[np.ndarray, float, float]) -> np.ndarray:
    weights, a, b = model
    out = np.full(len(texts), -1.0)
    for lo, hi, data, offs in blocks(texts):
        packed, owner = units(data, offs)
        kinds, at = np.unique(packed, return_inverse=True)
        out[lo:hi] = _bag_top(decide(kinds, weights)[at], owner, hi - lo)
    return 1 / (1 + np.exp(-np.clip(a * out + b, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = MAX_ROWS) -> tuple[np.ndarray, float, float]:
    """A model from the texts of labelled ids; ids with two labels count with the larger one, null labels and ids not at all."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col(label_col).cast("int")).alias("_y"))
    order = [F.xxhash64(F.col("_id").cast("string")), F.col("_id")]
    picked = known.where("_y > 0").orderBy(*order).limit(max_rows).unionByName(known.where("_y = 0").orderBy(*order).limit(max_rows))
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(picked), "_id").select(F.xxhash64(F.col("_id").cast("string")).alias("key"), F.xxhash64("_text").alias("th"), "_y", "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            packed, owner = texts_units(b.column(3))
            bounds = np.searchsorted(owner, np.arange(b.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.ListArray.from_arrays(pa.array(bounds), pa.array(packed.astype(np.int64)))], ["key", "th", "y", "units"])

    def learn(found: pa.Table) -> pa.Table:
        # the same order on any plan, and one row of each id
        found = found.combine_chunks()
        found = found.take(pa.compute.sort_indices(found, [("key", "ascending"), ("th", "ascending")]))
        key = found["key"].to_numpy()
        found = found.filter(pa.array(np.append(True, key[1:] != key[:-1])[:len(key)]))
        lists = found["units"].combine_chunks()
        sizes = pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False)
        y, owner = found["y"].to_numpy(), np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        packed = [lists.flatten().to_numpy().astype(np.uint64)]
        del found, lists
        weights, a, b = train(packed.pop(), owner, y)
        return pa.table({"weights": [weights.tobytes()], "a": [float(a)], "b": [float(b)]}, schema=pa.schema([("weights", pa.binary()), ("a", pa.float64()), ("b", pa.float64())]))

    rows = by_batches(texts, run, "key long, th long, y int, units array<long>").groupBy(F.lit(0).alias("all")).applyInArrow(learn, "weights binary, a double, b double").collect()
    if not rows:
        return train(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32))
    return np.frombuffer(bytes(rows[0]["weights"])), rows[0]["a"], rows[0]["b"]


def toxicity(docs: DataFrame, model: tuple[np.ndarray, float, float], id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7, score_col: str = "score", predicted_col: str = "predicted") -> DataFrame:
    """All columns of ``docs`` with ``score_col`` (double) and ``predicted_col`` (int) added, in place of columns so named.

    Null and empty texts, and texts without a unit, get the score of the decision value -1. Ids are not read, so null and
    repeated ones are like others; repeated texts get equal scores. A very long text is scored whole. An empty table
    gives no rows; a model of one class only scores all alike.
    """
    kept = [f for f in docs.schema.fields if f.name.lower() not in (score_col.lower(), predicted_col.lower())]
    schema = T.StructType([*kept, T.StructField(score_col, T.DoubleType()), T.StructField(predicted_col, T.IntegerType())])
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = score_texts(b.column(names.index(text_col)), model)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score), pa.array((score >= threshold).astype(np.int32))], schema.names)

    return by_batches(docs.select(*[c for c, f in zip(columns(docs), docs.schema.fields) if f in kept]), run, schema)
