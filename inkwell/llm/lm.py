"""Language-model scoring: the marginal likelihood of a text over all its subword segmentations.

The lattice of a word has an edge for each vocabulary piece in it, from its start to its end mark. Pieces
come from an existing public vocabulary; its scores (merge ranks) give the first weights, which
expectation-maximisation over all training words then refits. All segmentations are summed by one forward
recursion in log space.

With ``words_as_edges`` the vocabulary is that of the training texts too. Their most frequent words are
pieces like the others, so they also serve inside longer words (before a comma, in compounds), and each
training word is an edge from the start past the end mark. Such an edge weighs as often as the texts have
the word, less a discount of part of one occurrence, which is what the word leaves to its spellings: so
each word trains the pieces with that part once, and all that can be read sums to one:

    P(word | z) = edge of the whole word in z
                  + left in z * sum over segmentations of the product of the pieces' weights in z

Weights are those of a few latent classes of texts, found without labels (languages, mostly). A text's
probability is the sum over classes of the class's share times the product over its words and one end.
The vocabulary's pieces alone (``words_as_edges=False``) score held-out texts far below the contract's
base of word counts; README has the figures.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import column_of, fold_of, materialise, mix64, text_blocks

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Pieces of more bytes are not used.
LONGEST_PIECE = 16
#: Words of more bytes are scored one at a time.
LONGEST_TOGETHER = 64
EM_ROUNDS = 2
#: Most frequent words, whose scores every task gets; all other words are joined.
HEAD_WORDS = 200_000
#: Occurrences of words that a task counts at once.
FLUSH_WORDS = 1_000_000
#: Words whose lattices are worked on together, and bytes of texts that are scored together.
TOGETHER_WORDS, TOGETHER_BYTES = 40_000, 1 << 22
#: Frequent training words that are pieces.
WORD_PIECES = 20_000
#: Latent classes, the rounds that find them, and the share of their word weights that is everyone's.
CLASSES, CLASS_ROUNDS, SHARED = 6, 8, 0.03
#: Bins of bytes for the profile of a text: letters without case, bytes of longer characters, digits.
_BINS = np.full(256, 47, np.int64)
for _b in range(26):
    _BINS[0x41 + _b] = _BINS[0x61 + _b] = _b
_BINS[0x80:0xC0] = 26 + (np.arange(64) & 15)
_BINS[0xC0:] = 42 + (np.arange(64) >> 1 & 3)
_BINS[0x30:0x3A] = 46
FEATURES = 47
_B = np.uint64(0x9E3779B97F4A7C15)


def load_pieces(path: str = VOCABULARY, longest: int = LONGEST_PIECE) -> tuple[list[bytes], np.ndarray]:
    """Pieces as bytes, a word's start as a space, with first weights from the vocabulary's scores.

    The vocabulary's scores are minus the rank, so weights fall as 1 / rank. Every single byte is a
    piece, so each word has a segmentation.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found: dict[bytes, float] = {bytes([b]): 1e-3 / 256 for b in range(256)}
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i):
            continue
        piece = model.id_to_piece(i).replace("▁", " ").encode()
        if len(piece) <= longest and b" " not in piece[1:] and piece.lower() == piece:
            found[piece] = found.get(piece, 0.0) + 1.0 / (20.0 - model.get_score(i))
    pieces = sorted(found)
    weights = np.array([found[p] for p in pieces])
    return pieces, weights / weights.sum()


def _hash(piece: bytes) -> int:
    h = 0
    for b in piece:
        h = (h * int(_B) + b + 1) & (1 << 64) - 1
    return h


def lattice_table(pieces: list[bytes], weights: np.ndarray, ends: np.ndarray) -> dict:
    """Pieces by their hashes, and log weights of each class (a row; the last column is no piece); plain
    data. ``slots`` has the piece of each part of the hash range, -1 for none and -2 for several."""
    hashes = np.array([_hash(p) for p in pieces], np.uint64)
    order = np.argsort(hashes)
    at = (mix64(hashes) >> np.uint64(44)).astype(np.int64)
    slots = np.full(1 << 20, -1, np.int32)
    slots[at] = np.arange(len(at))
    slots[at[np.bincount(at, minlength=1 << 20)[at] > 1]] = -2
    with np.errstate(divide="ignore"):
        logs = np.log(np.hstack([weights, np.zeros((len(weights), 1))]))
    return {"hashes": hashes, "order": order, "slots": slots, "logs": logs, "ends": np.log(ends), "longest": max(map(len, pieces)), "by_piece": {p: i for i, p in enumerate(pieces)}}


def _edges(table: dict, x: np.ndarray) -> list[tuple[np.ndarray, list[bool]]]:
    """For words of one length, as rows of bytes: by piece length, piece ids (-1 for none) at each
    place, and whether any word has a piece there."""
    n, size = x.shape
    h = np.zeros((n, size), np.uint64)
    hashes, order = table["hashes"], table["order"]
    out = []
    for k in range(1, min(size, table["longest"]) + 1):
        h = h[:, : size - k + 1] * _B + x[:, k - 1 :] + np.uint64(1)
        ids = table["slots"][(mix64(h) >> np.uint64(44)).astype(np.int64)]
        some = np.flatnonzero(ids != -1)
        own, at = h.reshape(-1)[some], ids.reshape(-1)[some]
        several = np.flatnonzero(at == -2)
        at[several] = order[np.minimum(np.searchsorted(hashes, own[several], sorter=order), len(order) - 1)]
        at[hashes[at] != own] = -1
        ids.reshape(-1)[some] = at
        out.append((ids, (ids >= 0).any(axis=0).tolist()))
    return out


def _forward(logs: np.ndarray, edges, n: int, size: int) -> np.ndarray:
    """Log sums over the segmentations of each prefix: (prefix length, class, word)."""
    a = np.full((size + 1, len(logs), n), -np.inf)
    a[0] = 0
    for j in range(1, size + 1):
        for k in range(1, min(j, len(edges)) + 1):
            if edges[k - 1][1][j - k]:
                ids = edges[k - 1][0][:, j - k]
                has = np.flatnonzero(ids >= 0)
                if 2 * len(has) > n:
                    np.logaddexp(a[j], a[j - k] + logs[:, ids], out=a[j])
                else:
                    a[j][:, has] = np.logaddexp(a[j][:, has], a[j - k][:, has] + logs[:, ids[has]])
    return a


def _by_length(words: list[bytes], longest: int = LONGEST_TOGETHER, most: int = 2048):
    """Positions and byte rows of words of one length, with the space that starts them."""
    groups: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        groups.setdefault(len(w) + 1, []).append(i)
    for size, at in groups.items():
        if size <= longest:
            for lo in range(0, len(at), most):
                own = at[lo : lo + most]
                yield size, own, np.frombuffer(b"".join(b" " + words[i] for i in own), np.uint8).reshape(len(own), size).astype(np.uint64)
        else:
            for i in at:
                yield size, [i], None


def _forward_one(table: dict, word: bytes, z: int) -> float:
    """The same recursion for a single long word; the state is a sum for each byte."""
    a, logs, ids, longest = [0.0], table["logs"][z].tolist(), table["by_piece"], table["longest"]
    for j in range(1, len(word) + 1):
        terms = [a[i] + logs[p] for i in range(max(0, j - longest), j) if (p := ids.get(word[i:j])) is not None and logs[p] > -math.inf]
        top = max(terms)
        a.append(top + math.log(sum(math.exp(t - top) for t in terms)))
    return a[-1]


def spelled(table: dict, words: list[bytes], left: np.ndarray | float = 0.0, whole: np.ndarray | None = None) -> np.ndarray:
    """Natural log of the sum over all ways through each word's lattice, with its end mark, by class.

    ``left`` is the log weight that spellings start with, ``whole`` that of each word's edge as a whole
    (a row for each word), which goes from the start past the end mark."""
    classes = len(table["logs"])
    out = np.zeros((len(words), classes))
    for size, at, x in _by_length(words):
        if x is None:
            out[at] = [_forward_one(table, b" " + words[at[0]], z) for z in range(classes)]
        else:
            out[at] = _forward(table["logs"], _edges(table, x), len(at), size)[size].T
    out += left + table["ends"]
    return out if whole is None else np.logaddexp(out, whole)


def _expected_one(table: dict, word: bytes, z: int, out: np.ndarray) -> None:
    """Add the expected uses of pieces over the segmentations of a single long word."""
    logs, ids, longest, size = table["logs"][z].tolist(), table["by_piece"], table["longest"], len(word)
    edges = lambda j: [(i, p) for i in range(max(0, j - longest), j) if (p := ids.get(word[i:j])) is not None and logs[p] > -math.inf]
    a = [0.0]
    for j in range(1, size + 1):
        terms = [a[i] + logs[p] for i, p in edges(j)]
        top = max(terms)
        a.append(top + math.log(sum(math.exp(t - top) for t in terms)))
    b = [-math.inf] * size + [0.0]
    for j in range(size, 0, -1):
        for i, p in edges(j):
            t = logs[p] + b[j]
            out[p] += math.exp(a[i] + t - a[size])
            top = max(b[i], t)
            if top > -math.inf:
                b[i] = top + math.log(math.exp(b[i] - top) + math.exp(t - top))


def expected_pieces(table: dict, words: list[bytes], own: np.ndarray, often: np.ndarray) -> np.ndarray:
    """Expected uses of each piece, by class, over the segmentations of the words, each as often as
    ``often`` says in its own class."""
    logs = table["logs"]
    out = np.zeros(logs.size)
    uses: list[np.ndarray] = []
    shares: list[np.ndarray] = []
    for size, at, x in _by_length(words):
        if x is None:
            z, one = int(own[at[0]]), np.zeros(logs.shape[1])
            _expected_one(table, b" " + words[at[0]], z, one)
            out[z * logs.shape[1] : (z + 1) * logs.shape[1]] += one * often[at[0]]
            continue
        n, z, edges = len(x), own[at], _edges(table, x)
        a, b = (np.full((size + 1, n), -np.inf) for _ in range(2))
        a[0] = b[size] = 0
        has = {}  # by start and length: the words with such an edge, its piece and log weight
        for k, (ids, some) in enumerate(edges, 1):
            for i in np.flatnonzero(some).tolist():
                r = np.flatnonzero(ids[:, i] >= 0)
                has[i, k] = r, z[r] * logs.shape[1] + ids[r, i], logs[z[r], ids[r, i]]
        for (i, k), (r, _, w) in sorted(has.items(), key=lambda e: sum(e[0])):
            a[i + k, r] = np.logaddexp(a[i + k, r], a[i, r] + w)
        for (i, k), (r, _, w) in sorted(has.items(), key=lambda e: -e[0][0]):
            b[i, r] = np.logaddexp(b[i, r], w + b[i + k, r])
        for (i, k), (r, place, w) in has.items():
            uses.append(place)
            shares.append(np.exp(a[i, r] + w + b[i + k, r] - a[size, r]) * often[at][r])
    if uses:
        out += np.bincount(np.concatenate(uses), np.concatenate(shares), minlength=out.size)
    return out.reshape(logs.shape)[:, :-1]


def _profiles(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Square roots of the shares of the bins of bytes of each row: vectors of length 1, or 0."""
    rows = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    count = np.bincount(rows * (FEATURES + 1) + _BINS[buf], minlength=(len(offs) - 1) * (FEATURES + 1)).reshape(-1, FEATURES + 1)[:, :FEATURES]
    return np.sqrt(count / np.maximum(1, count.sum(axis=1, keepdims=True))).astype(np.float32)


def _rows_of(column) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, FEATURES)


def _class_profiles(batches):
    for batch in batches:
        for _, _, buf, offs in text_blocks(batch.column(0)):
            x = _profiles(buf, offs)
            x = x[x.any(axis=1)]  # texts without letters or digits found no class
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * FEATURES), pa.array(x.reshape(-1)))], names=["x"])


def _nearness(centres: np.ndarray):
    """Each profile with how near its nearest centre is, in thousandths."""

    def run(batches):
        for batch in batches:
            near = np.round((_rows_of(batch.column(0)) @ centres.T).max(axis=1) * 1000)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(near.astype(np.int32))], names=["x", "near"])

    return run


def _class_sums(centres: np.ndarray):
    """Sums of the task's profiles by nearest centre."""

    def run(batches):
        sums = np.zeros((len(centres), FEATURES))
        for batch in batches:
            x = _rows_of(batch.column(0))
            own = (x @ centres.T).argmax(axis=1)
            for z in range(len(centres)):
                sums[z] += x[own == z].sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(sums.size)), pa.array(sums.reshape(-1))], names=["at", "s"])

    return run


def _summed(profiles: DataFrame, centres: np.ndarray) -> np.ndarray:
    """The centres after one round; those without any profile stay."""
    sums = np.zeros(centres.size)
    for at, s in profiles.mapInArrow(_class_sums(centres), "at long, s double").groupBy("at").agg(F.sum("s")).collect():
        sums[at] = s
    sums = sums.reshape(centres.shape)
    size = np.linalg.norm(sums, axis=1, keepdims=True)
    return np.where(size > 0, np.round(sums / np.maximum(size, 1e-9), 6), centres).astype(np.float32)


def find_classes(profiles: DataFrame, classes: int, rounds: int = CLASS_ROUNDS) -> np.ndarray:
    """Centres by k-means on the sphere over all profiles; a round gives the driver a sum for each
    centre and feature. Seeds are chosen one by one among the profiles far from those before: of the
    thousandth part of nearness in which the farthest 2 % end, the one of the least hash."""
    centres = _summed(profiles, np.zeros((1, FEATURES), np.float32))
    for _ in range(classes - 1):
        near = profiles.mapInArrow(_nearness(centres), "x array<float>, near int")
        levels = sorted(near.groupBy("near").agg(F.count("*"), F.min(F.struct(F.xxhash64("x"), "x"))).collect())
        left = sum(r[1] for r in levels) / 50
        for _, n, chosen in levels:
            left -= n
            if left <= 0:
                centres = np.vstack([centres, np.array(chosen[1], np.float32)])
                break
    centres = np.vstack([centres, np.zeros((classes - len(centres), FEATURES), np.float32)])
    for _ in range(rounds if classes > 1 else 0):
        centres = _summed(profiles, centres)
    return centres


def _tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, A-Z in lower case, and how many each text has; nulls have none."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    words = lists.flatten()
    full = pc.greater(pc.binary_length(words), 0)  # white space at an end leaves an empty word
    row = np.repeat(np.arange(len(texts)), lists.value_lengths().to_numpy())[full.to_numpy(zero_copy_only=False)]
    return words.filter(full), np.bincount(row, minlength=len(texts))


def _count(shared):
    """Words of the task's texts with their counts by class; an empty word is the end of a text."""

    def pack(held, ends):
        z, words, counts = [], [], []
        for k, parts in enumerate(held):
            if parts:
                found = pc.value_counts(pa.concat_arrays(parts))
                words.append(found.field("values").cast(pa.binary()))
                counts.append(found.field("counts"))
                z.append(np.full(len(found), k, np.int32))
        own = np.flatnonzero(ends)
        words.append(pa.array([b""] * len(own), pa.binary()))
        counts.append(pa.array(ends[own], pa.int64()))
        z.append(own.astype(np.int32))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(z)), pa.concat_arrays(words), pa.concat_arrays(counts)], names=["z", "word", "n"])

    def run(batches):
        centres = shared.value
        held: list[list[pa.Array]] = [[] for _ in centres]
        ends, many = np.zeros(len(centres), np.int64), 0
        for batch in batches:
            for lo, hi, buf, offs in text_blocks(batch.column(0)):
                own = (_profiles(buf, offs) @ centres.T).argmax(axis=1)
                words, n = _tokens(batch.column(0).slice(lo, hi - lo))
                kind = np.repeat(own, n)
                for z in np.unique(own).tolist():
                    held[z].append(words.filter(pa.array(kind == z)))
                ends += np.bincount(own, minlength=len(ends))
                many += len(words)
                if many > FLUSH_WORDS:
                    yield pack(held, ends)
                    held, ends, many = [[] for _ in centres], np.zeros(len(centres), np.int64), 0
        yield pack(held, ends)

    return run


def _expect(shared, classes: int, by_count: bool):
    """Expected uses of pieces by class; a word belongs to the class that has it most. A word counts as
    often as the texts have it, or once."""

    def run(batches):
        table = shared.value
        total = np.zeros((classes, table["logs"].shape[1]))  # the last column counts words
        words: list[bytes] = []
        kinds: list[np.ndarray] = []
        counts: list[np.ndarray] = []

        def add():
            own, often = np.concatenate([*kinds, np.zeros(0, np.int64)]), np.concatenate([*counts, np.zeros(0)])
            total[:, :-1] += expected_pieces(table, words, own, often)
            total[:, -1] += np.bincount(own, often, minlength=classes)
            for held in (words, kinds, counts):
                held.clear()

        for batch in batches:
            rows = column_of(batch, "word").to_pylist()
            own = np.array([column_of(batch, f"n{z}").to_numpy() for z in range(classes)]).argmax(axis=0)
            full = [bool(w) for w in rows]
            kinds.append(own[full])
            counts.append(column_of(batch, "n").to_numpy()[full].astype(float) if by_count else np.ones(sum(full)))
            words += [w for w in rows if w]
            if len(words) >= TOGETHER_WORDS:
                add()
        add()
        flat = total.reshape(-1)
        used = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(flat[used], pa.float64())], names=["piece", "n"])

    return run


def discounts(totals: dict) -> tuple[float, np.ndarray]:
    """The part of an occurrence that each training word leaves to spellings, from how many words are seen
    once and twice, and what spellings have of each class in all; an end's own extra count leaves it too."""
    n, of_class = totals["tokens"] + 1.0, np.array(totals["by_class"]) + 1.0
    d = (totals["once"] + 1.0) / (totals["once"] + 2.0 * totals["twice"] + 2.0)
    left = d * ((1 - SHARED) * (np.array(totals["parts"]) + 1.0) / of_class + SHARED * (totals["spelt"] + 1.0) / n)
    return d, left


def word_scores(table: dict, totals: dict, words: list[bytes], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log10 of the base's probability of words, and of the model's in each class. ``counts`` has a row
    for each word: the training count, then that of each class. An end is the empty word: it has no
    pieces, so its edge is its only way."""
    n, v = totals["tokens"], totals["distinct"]
    base = np.log10((counts[:, 0] + 1.0) / (n + v + 1.0))
    ends = np.array([not w for w in words], bool)
    if totals["words_as_edges"]:
        d, left = discounts(totals)
        more = counts + ends[:, None]
        kept = np.where(ends, 1.0, 1 - d / np.maximum(counts[:, 0], 1))[:, None]
        whole = kept * ((1 - SHARED) * (more[:, 1:] - d * ends[:, None]) / (np.array(totals["by_class"]) + 1.0) + SHARED * (more[:, :1] - d * ends[:, None]) / (n + 1.0))
    else:
        share = (totals["texts"] + 1.0) / (n + 2.0)
        left, whole = np.full(counts.shape[1] - 1, 1 - share), np.repeat(ends[:, None] * share, counts.shape[1] - 1, axis=1)
    with np.errstate(divide="ignore"):
        model = np.log(whole)
    rest = np.flatnonzero(~ends)
    if len(rest):
        model[rest] = spelled(table, [words[i] for i in rest], np.log(left), model[rest])
    return base, model / math.log(10)


def _score_words(shared, totals: dict, classes: int):
    """Adds both scores to rows of words and counts; each word of a batch is scored once."""

    def run(batches):
        table = shared.value
        for batch in batches:
            words = column_of(batch, "word").to_pylist()
            counts = np.array([column_of(batch, c).fill_null(0).to_numpy(zero_copy_only=False) for c in ("n", *(f"n{z}" for z in range(classes)))], np.float64).reshape(classes + 1, -1).T
            distinct = {w: i for i, w in enumerate(dict.fromkeys(words))}
            place = np.array([distinct[w] for w in words], np.int64)
            own = np.zeros((len(distinct), classes + 1))
            own[place] = counts
            base, model = word_scores(table, totals, list(distinct), own)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(base[place], pa.float64()), pa.array(list(model[place]), pa.list_(pa.float64()))], names=[*batch.schema.names, "base", "model"])

    return run


def _score_texts(head, classes: int):
    """A row for each text: what its head words give, and its other words, as often as it has them."""

    def run(batches):
        index, scores = head.value
        scores = np.vstack([scores, np.zeros((1, classes + 1))])  # the last row is that of other words
        other = len(scores) - 1
        end = pc.index_in(pa.scalar(""), index).as_py()
        for whole in batches:
            for start, stop, _, _ in text_blocks(column_of(whole, "_text"), TOGETHER_BYTES):
                batch = whole.slice(start, stop - start)
                words, n = _tokens(column_of(batch, "_text"))
                at = pc.index_in(words, index).fill_null(other).to_numpy()
                first = np.concatenate([[0], np.cumsum(n)])
                sums = np.tile(scores[other if end is None else end], (len(n), 1))
                lo = 0
                while lo < len(n):  # some texts at a time
                    hi = max(lo + 1, int(np.searchsorted(first, first[lo] + TOGETHER_WORDS, "right")) - 1)
                    full = lo + np.flatnonzero(n[lo:hi])
                    if len(full):
                        sums[full] += np.add.reduceat(scores[at[first[lo] : first[hi]]], first[full] - first[lo], axis=0)
                    lo = hi
                missed = at == other
                upto = np.concatenate([[0], np.cumsum(missed)])
                known = n - (upto[first[1:]] - upto[first[:-1]]) + (end is not None)
                ends = upto[first]
                rest = words.filter(pa.array(missed)).cast(pa.binary())
                if end is None:  # an end that is no head word is one of the others
                    rest = pa.array([w for k in range(len(n)) for w in [*rest[ends[k] : ends[k + 1]].to_pylist(), b""]], pa.binary())
                    ends = ends + np.arange(len(ends))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * (classes + 1)), pa.array(sums.reshape(-1)))
                others = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), rest)
                yield pa.RecordBatch.from_arrays([*(column_of(batch, c) for c in ("_rid", "_id", "_held")), lists, pa.array(known), pa.array(n + 1), others], names=["_rid", "_id", "_held", "sums", "known", "tokens", "words"])

    return run


def frequent_words(vocabulary: DataFrame, many: int) -> list[bytes]:
    """The most frequent training words that are short enough for a piece, ties by bytes; at most ``many``."""
    short = F.length("word").between(1, LONGEST_PIECE - 1)
    return [bytes(r[0]) for r in vocabulary.where(short).orderBy(F.desc("n"), "word").select("word").limit(many).collect()]


def train_lattice(vocabulary: DataFrame, classes: int, path: str = VOCABULARY, rounds: int = EM_ROUNDS, words_as_edges: bool = True, word_pieces: int = WORD_PIECES) -> dict:
    """Refit piece weights on all training words; the driver gets a row for each piece and class. Frequent
    words are further pieces, which share a tenth of the first weights equally. Where words are edges too,
    each leaves the same part of an occurrence to its pieces, so it counts once; else as often as it occurs."""
    context = vocabulary.sparkSession.sparkContext
    pieces, first = load_pieces(path)
    if words_as_edges:
        have = set(pieces)
        more = [b" " + w for w in frequent_words(vocabulary, word_pieces) if b" " + w not in have]
        if more:
            pieces, first = pieces + more, np.concatenate([first * 0.9, np.full(len(more), 0.1 / len(more))])
    size = len(pieces) + 1
    table = lattice_table(pieces, np.tile(first * 0.75, (classes, 1)), np.full(classes, 0.25))
    for _ in range(rounds):
        shared = context.broadcast(table)
        uses = np.zeros(classes * size)
        for piece, n in vocabulary.mapInArrow(_expect(shared, classes, not words_as_edges), "piece long, n double").groupBy("piece").agg(F.sum("n")).collect():
            uses[piece] = n
        uses = uses.reshape(classes, size)
        words, uses = uses[:, -1:], uses[:, :-1] + first * 10.0
        total = uses.sum(axis=1, keepdims=True) + words + 1
        table = lattice_table(pieces, np.round(uses / total, 15), ((words + 1) / total)[:, 0])
    return table


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held_fold: int = 2, path: str = VOCABULARY, head_words: int = HEAD_WORDS, rounds: int = EM_ROUNDS, classes: int = CLASSES, words_as_edges: bool = True) -> DataFrame:
    """One row per input row: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are the words between white space after A-Z became lower-case, then one end; null counts
    as empty. Rows of the held-out fold (crc32 of the id) train nothing. Word counts and piece
    weights come from all other rows. ``base_score`` is the sum of log10 of add-one unigram
    probabilities, ``score`` the model's log10 probability of the text. Classes, counts and weights
    come from all training rows. ``words_as_edges=False`` scores by the vocabulary's pieces alone; see
    the module.

    At most ``head_words`` of the most frequent words are sent to every task; the others, none of
    them frequent in training texts, are joined by shuffle, where Spark splits what held-out rows repeat. Ids may be null or repeat; with nothing to
    train on, every word is spelled from pieces of the first weights; empty tables give no rows.
    """
    spark = docs.sparkSession
    context = spark.sparkContext
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("_id"), (fold_of(id_col, folds) == held_fold).alias("_held"), F.col(text_col).alias("_text"))
    train = rows.where("not _held").select("_text")
    profiles = materialise(train.mapInArrow(_class_profiles, "x array<float>"), "profiles") if classes > 1 else None
    centres = context.broadcast(find_classes(profiles, classes) if classes > 1 else np.zeros((1, FEATURES), np.float32))
    by_class = [F.sum(F.when(F.col("z") == z, F.col("n")).otherwise(0)).alias(f"n{z}") for z in range(classes)]
    counts = train.mapInArrow(_count(centres), "z int, word binary, n long").groupBy("word").agg(F.sum("n").alias("n"), *by_class)
    counts = materialise(counts, "counts")
    level = F.floor(F.log2("n") * 8).cast("int")
    levels = {r[0]: r for r in counts.groupBy(level).agg(F.count("*"), F.sum("n"), F.sum((F.col("n") == 1).cast("long")), F.sum((F.col("n") == 2).cast("long")), F.sum((F.length("word") > 0).cast("long")), *[F.sum(f"n{z}") for z in range(classes)], *[F.sum(F.when(F.length("word") > 0, F.col(f"n{z}") / F.col("n")).otherwise(0)) for z in range(classes)]).collect()}
    totals = {"distinct": sum(r[1] for r in levels.values()), "tokens": sum(r[2] for r in levels.values()), "once": sum(r[3] for r in levels.values()), "twice": sum(r[4] for r in levels.values()), "spelt": sum(r[5] for r in levels.values())}
    totals |= {"by_class": [sum(r[6 + z] for r in levels.values()) for z in range(classes)], "parts": [round(sum(r[6 + classes + z] for r in levels.values()), 6) for z in range(classes)]}
    cut, room = max(levels, default=0) + 1, head_words
    for k in sorted(levels, reverse=True):
        room -= levels[k][1]
        if room < 0:
            break
        cut = k
    texts = counts.where("word = X''").first()
    texts = np.array([texts[f"n{z}"] if texts else 0 for z in range(classes)], np.float64)
    totals |= {"words_as_edges": words_as_edges, "texts": float(texts.sum())}
    shares = np.log10((texts + 1) / (texts.sum() + classes))
    table = context.broadcast(train_lattice(counts, classes, path, rounds, words_as_edges))
    names = [f"n{z}" for z in range(classes)]
    columns = "word binary, n long, " + ", ".join(f"{c} long" for c in names)
    scored = materialise(counts.select("word", "n", *names).mapInArrow(_score_words(table, totals, classes), f"{columns}, base double, model array<double>").drop(*names), "words")
    inside = level >= cut
    top = scored.where(inside).select("word", "base", "model").toArrow()
    top = top.sort_by("word") if top.num_rows else top
    matrix = np.hstack([top["base"].to_numpy()[:, None], top["model"].combine_chunks().flatten().to_numpy().reshape(-1, classes)]) if top.num_rows else np.zeros((0, classes + 1))
    head = context.broadcast((pa.array(top["word"].to_pylist(), pa.binary()).cast(pa.string()), matrix))

    numbered = rows.withColumn("_rid", F.monotonically_increasing_id())
    parts = materialise(numbered.mapInArrow(_score_texts(head, classes), f"_rid long, _id {id_type}, _held boolean, sums array<double>, known long, tokens long, words array<binary>"), "texts")
    others = parts.select("_rid", F.explode("words").alias("word"))
    met = others.join(scored.where(~inside), "word", "left")
    seen = met.where("n is not null").select("_rid", "n", "base", "model")
    new = met.where("n is null").select("_rid", "word", "n", *[F.lit(0).cast("long").alias(c) for c in names])
    new = new.mapInArrow(_score_words(table, totals, classes), f"_rid long, {columns}, base double, model array<double>")
    more = seen.unionByName(new.select("_rid", "n", "base", "model")).groupBy("_rid").agg(
        F.sum("base").alias("more"),
        F.sum((F.coalesce("n", F.lit(0)) > 0).cast("long")).alias("known_more"),
        *[F.sum(F.col("model")[z]).alias(f"more{z}") for z in range(classes)],
    )
    by_z = [F.col("sums")[z + 1] + F.coalesce(f"more{z}", F.lit(0.0)) + F.lit(float(shares[z])) for z in range(classes)]
    out = parts.drop("words").join(more, "_rid", "left").withColumns({f"z{z}": t for z, t in enumerate(by_z)})
    best = F.array_max(F.array(*[f"z{z}" for z in range(classes)]))
    rest = sum((F.pow(F.lit(10.0), F.col(f"z{z}") - F.col("best")) for z in range(1, classes)), F.pow(F.lit(10.0), F.col("z0") - F.col("best")))
    return out.withColumn("best", best).select(
        F.col("_id").alias(id_col),
        F.col("_held").alias("held_out"),
        F.col("tokens").alias("n_tokens"),
        (F.col("known") + F.coalesce("known_more", F.lit(0))).cast("long").alias("n_known"),
        F.lit(totals["tokens"]).cast("long").alias("train_tokens"),
        (F.col("sums")[0] + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        (F.col("best") + F.log10(rest)).alias("score"),
    )
