"""Toxicity by a subsequence string kernel with Nyström landmarks.

Two strings are alike when they share subsequences of three characters, each
weighted down for every character in between (``DECAY`` per gap, at most
``REACH`` characters in all).  An insult keeps most of its subsequences when
characters are put between its letters, so ``i.d.i-o.t`` stays near ``idiot``; a
piece with signs inside is also weighed without them, as gaps of no width.

The kernel is approximated by its values against a few landmark strings
(Nyström: the inverse square root of the landmarks' own kernel matrix), and a
linear support vector machine is trained on that map.  Labels belong to
documents, so training is by multiple instances: a toxic document answers for
its worst string (a word, or a run of spaced letters), a clean document for all
of its strings; no string spans several words.  Landmarks, map and machine
fold into one weight per subsequence; scoring is a sum of table entries, done
once for every distinct string of a worker.

The fit uses a bounded sample of labelled documents (``SAMPLE_TOXIC``,
``SAMPLE_CLEAN``), chosen by a hash of the id; scoring covers whole texts of
all documents.  Labels, language, source and id are never part of a score.

Defined cases: a NULL or empty text scores as one without any string; a NULL id
is carried through and never trained on; labels of NULL are not used, a
document with several labels is toxic if any says so; repeated rows score alike;
without two labelled documents of both kinds ``fit`` raises ``ValueError``, or
returns ``otherwise`` if that is given (``UNDECIDED``: every score is 0.5).
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from residuum.llm.bytewords import byte_class, mix, prefix_sums, stretch_hash, text_bytes
from residuum.llm.shared import held, slices
from residuum.llm.words import PieceMemory, Pieces

DECAY = 0.6
REACH = 6
#: Bounds of the labelled sample that the machine is fitted on, in documents.
SAMPLE_TOXIC = 1000
SAMPLE_CLEAN = 2000
#: Bounds of the fit: landmarks from toxic and from clean strings, clean strings in a round.
LANDMARKS = 160
CLEAN_LANDMARKS = 64
CLEAN_STRINGS = 20_000
ROUNDS = 4
#: A string that so many toxic documents of the sample have, and no clean one, is an example by itself.
TELLING = 8
THRESHOLD = 0.7

_SIZE = 50
_BEGIN, _END = 48, 49
#: Digits and signs read as the letters they look like.
_LOOKS = str.maketrans("013457@$", "oieastas")
_LETTER = byte_class(bytes(range(97, 123)) + bytes(range(65, 91)))


def _code_table() -> np.ndarray:
    """Codes of the first characters: 1-26 for a-z, 27-47 shared by the other
    letters, 0 for anything else (a gap)."""
    table = np.zeros(0x250, np.int64)
    for c in range(len(table)):
        ch = chr(c)
        if "a" <= ch <= "z":
            table[c] = c - 96
        elif ch.isalpha():
            table[c] = 27 + c % 21
    return table


_CODES = _code_table()
_RUN = re.compile(r"(.)\1{2,}")
_EDGE = re.compile(r"^[^\w@$]+|[^\w@$]+$")
_SIGNS = re.compile(r"[\W_]+")


def normal_string(piece: str) -> str:
    """A piece as the kernel sees it: lower case, without edge punctuation and
    blanks, look-alike signs as letters, no character more than twice in a row."""
    low = _EDGE.sub("", piece.lower().replace(" ", ""))
    return _RUN.sub(r"\1\1", low.translate(_LOOKS)) if not low.isdigit() else ""


def _codes(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Character codes of all strings with begin and end marks and enough gaps
    between them that no subsequence joins two; the begin of each."""
    gap = "\0" * REACH
    flat = np.frombuffer(gap.join(f"\1{s}\2" for s in strings).encode("utf-32-le", "surrogatepass") + gap.encode("utf-32-le"), np.uint32)
    codes = np.where(flat < len(_CODES), _CODES[np.minimum(flat, len(_CODES) - 1)], 27 + flat % 21).astype(np.int64)
    codes[flat == 1], codes[flat == 2], codes[flat == 0] = _BEGIN, _END, 0
    begins = np.cumsum([0, *(len(s) + 2 + REACH for s in strings[:-1])])
    return codes, begins


def _subsequences(codes: np.ndarray):
    """For each pair of distances: table places, which are real, and weight."""
    n = len(codes) - REACH + 1
    for b in range(2, REACH):
        for a in range(1, b):
            x, y, z = codes[:n], codes[a:a + n], codes[b:b + n]
            yield (x * _SIZE + y) * _SIZE + z, (x > 0) & (y > 0) & (z > 0), DECAY ** (b - 2)


def weigh(strings: list[str], table: np.ndarray, rows: np.ndarray | None = None) -> np.ndarray:
    """The sum of table weights over each string's subsequences, each by its
    gaps, over the string's norm.  The table has one column, or several;
    ``rows`` tells the table row of each subsequence (without it, its place)."""
    if not strings:
        return np.zeros((0, *table.shape[1:]), np.float32)
    codes, begins = _codes(strings)
    total = np.zeros((len(codes) - REACH + 1, *table.shape[1:]), np.float32)
    norm = np.zeros(len(total), np.float32)
    for place, real, weight in _subsequences(codes):
        at = np.flatnonzero(real)
        norm[at] += np.float32(weight * weight)
        own = place[at] if rows is None else rows[place[at]]
        if rows is not None:
            at, own = at[own >= 0], own[own >= 0]
        total[at] += np.float32(weight) * table[own]
    sums = np.add.reduceat(total, begins, axis=0)
    scale = 1 / np.sqrt(np.maximum(np.add.reduceat(norm, begins), 1e-9))
    return sums * (scale if sums.ndim == 1 else scale[:, None])


def _features(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Explicit kernel features of a few strings, one row each, by the norm;
    and the places of the subsequences that occur, one a column."""
    codes, begins = _codes(strings)
    norm = np.zeros(len(codes) - REACH + 1, np.float32)
    owner = np.searchsorted(begins, np.arange(len(norm)), "right") - 1
    owners, places, weights = [], [], []
    for place, real, weight in _subsequences(codes):
        at = np.flatnonzero(real)
        norm[at] += np.float32(weight * weight)
        owners.append(owner[at])
        places.append(place[at])
        weights.append(np.full(len(at), weight, np.float32))
    found, column = np.unique(np.concatenate(places), return_inverse=True)
    out = np.zeros((len(strings), len(found)), np.float32)
    np.add.at(out, (np.concatenate(owners), column), np.concatenate(weights))
    return out / np.sqrt(np.maximum(np.add.reduceat(norm, begins), 1e-9))[:, None], found


@dataclass
class Model:
    """``score = 1 / (1 + exp(-(slope * worst + shift)))`` with ``worst`` the
    largest of ``weigh(string, table) + bias`` over a document's strings."""

    table: np.ndarray
    bias: float
    slope: float
    shift: float

    def strings(self, pieces: list[str]) -> np.ndarray:
        """The kernel's value of every piece; one with signs between its letters
        counts as it stands or without them, whichever is worse."""
        forms = [normal_string(p) for p in pieces]
        values = weigh(forms, self.table)
        signed = [i for i, x in enumerate(forms) if not x.isalnum() and x]
        bare = [_SIGNS.sub("", forms[i]) for i in signed]
        values[signed] = np.maximum(values[signed], weigh(bare, self.table))
        return values + np.float32(self.bias)


#: Says nothing: the score of every text is 0.5.
UNDECIDED = Model(np.zeros(_SIZE ** 3, np.float32), 0.0, 0.0, 0.0)


def _train_svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """L2-regularised squared-hinge machine by Newton steps; the last weight is
    the intercept."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)]).astype(np.float64)
    w = np.zeros(x.shape[1])
    ridge = np.eye(len(w))
    ridge[-1, -1] = 1e-6
    loss = lambda v: v @ ridge @ v / 2 + (cost * np.maximum(0, 1 - y * (x @ v)) ** 2).sum()
    for _ in range(30):
        active = y * (x @ w) < 1
        xa, ca = x[active], cost[active]
        grad = ridge @ w - 2 * xa.T @ (ca * (y[active] - xa @ w))
        step = np.linalg.solve(ridge + 2 * (xa.T * ca) @ xa, grad)
        size, now = 1.0, loss(w)
        while size > 1e-4 and loss(w - size * step) > now:
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-6:
            break
    return w


def _calibrate(worst: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Platt's sigmoid with smoothed targets, by Newton steps."""
    n1, n0 = toxic.sum(), (~toxic).sum()
    target = np.where(toxic, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([worst, np.ones(len(worst))], 1)
    v = np.array([1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ v, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p) + 1e-9)) @ x + 1e-6 * np.eye(2), x.T @ (p - target) + 1e-6 * v)
        v = v - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-7:
            break
    return float(v[0]), float(v[1])


def fit_documents(documents: list[tuple[bool, tuple[str, ...] | list[str]]], seed: int = 7) -> Model:
    """Fit on documents given as (toxic, distinct strings)."""
    rng = np.random.default_rng(seed)
    toxic_docs = _distinct([sorted(s) for t, s in documents if t and s])
    clean_docs = _distinct([sorted(s) for t, s in documents if not t and s])
    if len(toxic_docs) < 2 or len(clean_docs) < 2:
        raise ValueError("labelled documents of both kinds are needed")
    # every fourth document calibrates, the others train
    train_t, hold_t = [d for i, d in enumerate(toxic_docs) if i % 4], [d for i, d in enumerate(toxic_docs) if i % 4 == 0]
    train_c, hold_c = [d for i, d in enumerate(clean_docs) if i % 4], [d for i, d in enumerate(clean_docs) if i % 4 == 0]
    in_toxic, in_clean = Counter(w for d in train_t for w in d), Counter(w for d in train_c for w in d)
    nt, nc = len(train_t), len(train_c)
    odds = {w: np.log((n + 0.5) / (nt + 1)) - np.log((in_clean[w] + 0.5) / (nc + 1)) for w, n in in_toxic.items()}
    ranked = sorted(odds, key=lambda w: (in_toxic[w] * max(odds[w], 0), w), reverse=True)[:2 * LANDMARKS]
    clean_all = sorted(in_clean)
    chosen = rng.permutation(len(clean_all))
    others = [clean_all[i] for i in chosen[:CLEAN_LANDMARKS]]
    # landmarks: the strings that speak most for toxicity, then others unlike them
    phi, found = _features([*ranked, *others])
    worth = np.array([in_toxic[w] * max(odds[w], 0) for w in ranked])
    landmarks = list(range(min(LANDMARKS // 4, len(ranked))))
    covered = (phi[:len(ranked)] @ phi[landmarks].T).max(axis=1)
    covered[landmarks] = 1
    for _ in range(min(LANDMARKS, len(ranked)) - len(landmarks)):
        gain = worth * (1 - np.minimum(covered, 1))
        best = int(np.argmax(gain))
        if gain[best] <= 0:
            break
        landmarks.append(best)
        covered = np.maximum(covered, phi[:len(ranked)] @ phi[best])
        covered[best] = 1
    basis = phi[[*landmarks, *range(len(ranked), len(phi))]]
    values, vectors = np.linalg.eigh((basis @ basis.T).astype(np.float64))
    good = values > 1e-6 * values.max()
    inverse_root = (vectors[:, good] / np.sqrt(values[good])).astype(np.float32)
    # the Nyström map as one table column per direction
    table = np.ascontiguousarray((inverse_root.T @ basis).T)
    rows = np.full(_SIZE ** 3, -1, np.int32)
    rows[found] = np.arange(len(found), dtype=np.int32)
    # strings that only toxic documents have, often enough not to be chance
    telling = sorted(x for x, n in in_toxic.items() if n >= TELLING and not in_clean[x])
    vocabulary = sorted(set(in_toxic) | set(in_clean))
    place = {x: i for i, x in enumerate(vocabulary)}
    places = [np.array([place[x] for x in d]) for d in [*train_t, *train_c]]
    start = np.array([odds.get(x, 0.0) * in_toxic[x] for x in vocabulary])
    worst = [int(p[np.argmax(start[p])]) for p in places[:nt]]
    negatives = sorted(place[clean_all[i]] for i in chosen[:CLEAN_STRINGS])
    hard: list[int] = []
    for _ in range(ROUNDS):
        kinds = Counter(vocabulary[i] for i in worst)
        kinds |= Counter({x: in_toxic[x] for x in telling})
        strings, y, cost = [], [], []
        for x, n in sorted(kinds.items()):
            for k, form in enumerate([x, *_disguised(x, rng)]):
                strings.append(form)
                y.append(1.0)
                cost.append(min(n, 400) ** 0.5 * (2.0 if k == 0 else 1.0))
        for some, each in ((negatives, 0.5), (hard, 4.0)):
            strings += [vocabulary[i] for i in some]
            y += [-1.0] * len(some)
            cost += [each] * len(some)
        w = _train_svm(_in_parts(strings, table, rows), np.array(y), np.array(cost))
        flat = np.zeros(_SIZE ** 3, np.float32)
        flat[found] = table @ w[:-1].astype(np.float32)
        values = _in_parts(vocabulary, flat)
        worst = [int(p[np.argmax(values[p])]) for p in places[:nt]]
        hard = sorted({*hard, *(int(i) for p in places[nt:] for i in p[np.argsort(-values[p])[:3]])})
    bias = float(w[-1])
    held = np.array([float(weigh(d, flat).max()) + bias for d in [*hold_t, *hold_c]])
    slope, shift = _calibrate(held, np.arange(len(held)) < len(hold_t))
    return Model(flat, bias, slope, shift)


def _distinct(documents: list[list[str]]) -> list[list[str]]:
    """One of each group of copies: their strings would count as independent
    evidence.  Copies share several of eight smallest string hashes."""
    seen: dict[tuple[int, int], int] = {}
    out = []
    for d in documents:
        codes = np.array([zlib.crc32(x.encode("utf-8", "surrogatepass")) for x in d], np.uint64)
        marks = [(k, int(mix(codes + np.uint64(k << 40)).min())) for k in range(8)]
        votes = Counter(seen[m] for m in marks if m in seen)
        if votes and max(votes.values()) >= 3:
            continue
        for m in marks:
            seen[m] = len(out)
        out.append(d)
    return out


def _in_parts(strings: list[str], table: np.ndarray, rows: np.ndarray | None = None) -> np.ndarray:
    step = 20_000 if table.ndim == 1 else 1000
    return np.concatenate([weigh(strings[i:i + step], table, rows) for i in range(0, len(strings), step)])


def _disguised(x: str, rng: np.random.Generator) -> list[str]:
    """Forms of an insult that the machine shall know too: a sign between all
    letters, and a letter put in somewhere."""
    if len(x) < 4:
        return []
    forms = [".".join(x)]
    for at in rng.integers(1, len(x), 2).tolist():
        forms.append(x[:at] + chr(97 + int(rng.integers(26))) + x[at:])
    return forms


class Strings:
    """The strings of a slice of texts: its pieces, and runs of three or more
    single letters as one more string each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        p = Pieces(data, offsets)
        self.pieces = p
        single = (p.ends - p.begins == 1)
        if single.any():
            single &= _LETTER[p.data[p.begins]]
        owner = np.repeat(np.arange(len(offsets) - 1), np.diff(p.rows))
        # a run ends with its document
        border = np.concatenate([[True], owner[1:] != owner[:-1], [True]])
        alone = np.concatenate([[False], single, [False]])
        first = np.flatnonzero(single & (border[:-1] | ~alone[:-2]))
        last = np.flatnonzero(single & (border[1:] | ~alone[2:]))
        long = last - first >= 2
        first, last = first[long], last[long]
        self.owner = np.concatenate([owner, owner[first]])
        if len(first):
            begins, ends = p.begins[first], p.ends[last]
            p.keys = np.concatenate([p.keys, stretch_hash(prefix_sums(p.data), begins, ends)])
            p.begins, p.ends = np.concatenate([p.begins, begins]), np.concatenate([p.ends, ends])


def sample_strings(docs: DataFrame, labels: DataFrame, usable: Column | None, n_toxic: int, n_clean: int,
                   id_col: str, text_col: str, label_col: str) -> list[tuple[bool, tuple[str, ...]]]:
    """The distinct strings of a bounded sample of labelled documents."""
    told = (labels.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{label_col}`").cast("int").alias("_toxic"))
            .filter("_id is not null and _toxic is not null").groupBy("_id").agg(F.max("_toxic").alias("_toxic")))
    if usable is not None:
        told = told.filter(usable)
    order = F.xxhash64("_id", F.lit("sample"))
    part = lambda k, n: told.filter(F.col("_toxic") == k).orderBy(order, "_id").limit(n)
    chosen = part(1, n_toxic).union(part(0, n_clean))
    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "_text", 1 << 20):
                s = Strings(*text_bytes(batch.column("_text")))
                found: list[set[str]] = [set() for _ in range(batch.num_rows)]
                _, first = np.unique(np.stack([s.pieces.keys, s.owner.astype(np.uint64)]), axis=1, return_index=True)
                for t, x in zip(s.owner[first].tolist(), s.pieces.texts(first)):
                    if x := normal_string(x):
                        found[t].add(x)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_id"), batch.column("_toxic"), pa.array([sorted(x) for x in found], pa.list_(pa.string()))],
                    names=["_id", "_toxic", "strings"])

    found = src.join(chosen, "_id").mapInArrow(run, "_id long, _toxic int, strings array<string>").toArrow()
    one: dict[str, str] = {}                 # each distinct string once in memory
    rows = [(i, t, tuple(one.setdefault(x, x) for x in s.as_py()))
            for i, t, s in zip(found["_id"].to_pylist(), found["_toxic"].to_pylist(), found["strings"])]
    return [(t == 1, s) for _, t, s in sorted(rows)]


def fit(docs: DataFrame, labels: DataFrame, usable: Column | None = None, n_toxic: int = SAMPLE_TOXIC,
        n_clean: int = SAMPLE_CLEAN, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        otherwise: Model | None = None) -> Model:
    """Fit on a bounded sample of labelled documents; ``usable`` is a condition
    on ``_id`` that limits which labels may be learnt from.  ``otherwise`` is the
    model for labels that do not hold both kinds."""
    sample = sample_strings(docs, labels, usable, n_toxic, n_clean, id_col, text_col, label_col)
    if otherwise is not None and not all(enough(sample)):
        return otherwise
    return fit_documents(sample)


def enough(documents: list[tuple[bool, tuple[str, ...]]]) -> tuple[bool, bool]:
    """Whether there are two different toxic documents, and two clean ones."""
    kinds = [_distinct([sorted(s) for t, s in documents if t == kind and s]) for kind in (True, False)]
    return len(kinds[0]) >= 2, len(kinds[1]) >= 2


def _worst(model: Model, memory: PieceMemory, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text the probability of toxicity and its worst string's byte range
    (-1, -1 without any string)."""
    data, offsets = text_bytes(column)
    s = Strings(data, offsets)
    n = len(column)
    worst = np.full(n, model.bias, np.float32)
    begin, end = np.full(n, -1), np.full(n, -1)
    if len(s.owner):
        at, _ = memory.look_up(s.pieces)
        values = memory.pool[at]
        order = np.lexsort((-values, s.owner))
        texts, first = np.unique(s.owner[order], return_index=True)
        top = order[first]
        worst[texts] = values[top]
        begin[texts], end[texts] = s.pieces.begins[top] - offsets[texts], s.pieces.ends[top] - offsets[texts]
    z = model.slope * worst.astype(np.float64) + model.shift
    return 1 / (1 + np.exp(-np.clip(z, -500, 500))), begin, end


def _memory(name: str, model: Model) -> PieceMemory:
    """The worker's memory of string scores."""
    return held(f"strings {name}", lambda: PieceMemory(lambda pieces: _as_bytes(model, pieces), "<f4"))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, score, start, end``: the probability of toxicity, and the byte
    range of the worst string (NULL in a text without strings)."""
    name = uuid.uuid4().hex
    shared = docs.sparkSession.sparkContext.broadcast(model)
    src = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text"))
    id_type = src.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = _memory(name, shared.value)
        for whole in batches:
            for batch in slices(whole, "_text"):
                p, begin, end = _worst(shared.value, memory, batch.column("_text"))
                none = begin < 0
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_id"), pa.array(p), pa.array(begin, pa.int32(), mask=none), pa.array(end, pa.int32(), mask=none)],
                    names=["_id", "score", "start", "end"])

    out = src.mapInArrow(run, f"_id {id_type}, score double, start int, end int")
    return out.select(F.col("_id").alias(id_col), "score", "start", "end")


def keep_clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score is below the threshold, as they are."""
    name, place = uuid.uuid4().hex, docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = _memory(name, shared.value)
        for whole in batches:
            for batch in slices(whole, place):
                yield batch.filter(pa.array(_worst(shared.value, memory, batch.column(place))[0] < threshold))

    return docs.mapInArrow(run, docs.schema)


def _as_bytes(model: Model, pieces: list[str]) -> list[bytes]:
    values = np.concatenate([model.strings(pieces[i:i + 20_000]) for i in range(0, len(pieces), 20_000)]).astype("<f4")
    raw = values.tobytes()
    return [raw[i:i + 4] for i in range(0, len(raw), 4)]
