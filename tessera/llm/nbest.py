"""N-best SentencePiece segmentation and decoding (operator 6).

A text is first normalised as its model says. The lattice of the result has a node before
and behind each character and an edge for each piece of the vocabulary that matches. A
forward Viterbi pass gives every node the score of its best path from the start. These
scores are exact heuristics for an A* search that runs backward from the end: the agenda
pops complete paths in falling order of score, so the first N are the N best.

If no piece has a white-space mark behind another character, no edge passes over a place
where a mark follows another character. There the lattice falls apart, a run of marks and
the word behind it being one segment, and the N best paths of the whole are combinations of
those of its segments; a text of any other model is one segment. A vectorised forward and
backward Viterbi pass over the distinct segments of many texts gives each one's best path
and the gap to its second best (the best path over an edge that the best path does not use).
Only the N - 1 places of a text with the smallest gaps can differ in its N best paths; these
segments are searched by A*.

The model file is a parameter. Scores of a unigram model are taken as they are. Where they
are merge ranks (a BPE vocabulary, whose scores say nothing about sums), log probabilities
follow from the ranks by the law of Zipf and Mandelbrot, 1 / (rank + ``SHIFT``), so no model
is trained here. Characters without a piece become byte pieces, at a score under all others.

Edge cases: a null or empty text has one segmentation, without pieces; texts with fewer
than N segmentations give all they have; equal scores come in a fixed order, so results
don't depend on partitions; whole texts of any length are encoded; a text that holds the
mark itself (U+2581), or that the model's normalisation changes, decodes to its normalised
form, and ``round_trip`` says so; repeated rows give equal results.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import count, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tessera.llm._common import documents, sliced

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
N_BEST = 4
MARK = "▁"
#: Of the law that turns ranks into probabilities.
SHIFT = 3000.0
#: Longer segments are searched alone; bytes of the texts that are solved together; code
#: points of the segments whose searches a worker remembers.
LONG, TOGETHER, REMEMBERED = 32, 12_000_000, 2_000_000
#: What no piece passes over, if none has a mark behind another character.
SEGMENT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


class Pieces:
    """A model's pieces, their scores, and what is needed to segment with them."""

    def __init__(self, model: bytes) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = sp.vocab_size()
        self.byte_id, self.text, scores = [0] * 256, [b""] * size, {}
        for i in range(size):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.text[i] = bytes([int(piece[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.text[i] = piece.replace(MARK, " ").encode()
                scores[piece] = (i, sp.get_score(i))
        self.normalised = sp.normalize
        self.prefixed = sp.normalize("a")[0] == MARK
        self.divisible = not any(re.search(f"[^{MARK}]{MARK}", p) for p in scores)
        if sorted(-s for _, s in scores.values())[-1] >= len(scores) // 2:  # ranks, not log probabilities
            total = np.log((1 / (np.arange(size) + SHIFT)).sum())
            scores = {p: (i, float(-np.log(SHIFT - s) - total)) for p, (i, s) in scores.items()}
        self.scores = scores
        self.unknown = min(s for _, s in scores.values()) - 10
        self.longest = max(map(len, scores))
        # a trie whose steps, from state * alphabet + character, are in a hash table
        chars = sorted({c for p in scores for c in p})
        number = {c: k for k, c in enumerate(chars)}
        self.alphabet, self.of_code = len(chars), np.full(0x110000, -1, np.int32)
        self.of_code[[ord(c) for c in chars]] = np.arange(len(chars))
        states: dict[str, int] = {"": 0}
        for p in scores:
            for k in range(1, len(p) + 1):
                states.setdefault(p[:k], len(states))
        self.bits = max(8, len(states).bit_length() + 2)
        self.keys, self.to = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int64)
        steps = np.array([(states[p[:-1]] * len(chars) + number[p[-1]], s) for p, s in states.items() if p], np.int64)
        for (key, to), at in zip(steps.tolist(), self._slot(steps[:, 0]).tolist(), strict=True):
            while self.keys[at] >= 0:
                at = (at + 1) % len(self.keys)
            self.keys[at], self.to[at] = key, to
        self.piece_at, self.score_at = np.full(len(states), -1, np.int32), np.full(len(states), -np.inf)
        for p, (i, s) in scores.items():
            self.piece_at[states[p]], self.score_at[states[p]] = i, s
        self.first = np.zeros(len(chars), np.int64)
        for p, s in states.items():
            if len(p) == 1:
                self.first[number[p]] = s

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def step(self, state: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The states that ``char`` leads to; -1: none."""
        key = state * self.alphabet + char
        at = self._slot(key)
        out, open_ = self.to[at], np.flatnonzero((self.keys[at] != key) & (self.keys[at] >= 0))
        out[self.keys[at] != key] = -1
        while len(open_):
            at[open_] = (at[open_] + 1) % len(self.keys)
            seen = self.keys[at[open_]]
            hit = open_[seen == key[open_]]
            out[hit] = self.to[at[hit]]
            open_ = open_[(seen != key[open_]) & (seen >= 0)]
        return out

    def edges(self, segment: str) -> list[list[tuple[int, tuple[int, ...], float]]]:
        """For each node, the edges that end there: (start, ids, score)."""
        ends: list[list[tuple[int, tuple[int, ...], float]]] = [[] for _ in range(len(segment) + 1)]
        for i, c in enumerate(segment):
            if c not in self.scores:
                ends[i + 1].append((i, tuple(self.byte_id[b] for b in c.encode("utf-8", "surrogatepass")), self.unknown))
            for j in range(i + 1, min(i + self.longest, len(segment)) + 1):
                if found := self.scores.get(segment[i:j]):
                    ends[j].append((i, (found[0],), found[1]))
        return ends

    def search(self, segment: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The n best paths, best first, by A*."""
        ends = self.edges(segment)
        best = [0.0] + [-np.inf] * len(segment)
        for j in range(1, len(segment) + 1):
            best[j] = max((best[i] + s for i, _, s in ends[j]), default=-np.inf)
        # (-(score behind the node + best before it), node, order, score behind, path behind):
        # of equal sums, rounded so that they are equal, the one nearest to the start comes
        # first, so that ties are walked to their end and not all opened
        order = count()
        agenda = [(round(-best[-1], 6), len(segment), next(order), 0.0, None)]
        found: list[tuple[float, tuple[int, ...]]] = []
        while agenda and len(found) < n:
            _, node, _, behind, path = heapq.heappop(agenda)
            if node == 0:
                ids: list[int] = []
                while path:
                    ids += path[0]
                    path = path[1]
                found.append((behind, tuple(ids)))
                continue
            for i, piece, s in ends[node]:
                if best[i] > -np.inf:
                    heapq.heappush(agenda, (round(-(behind + s + best[i]), 6), i, next(order), behind + s, (piece, path)))
        return sorted(found, key=lambda x: (-round(x[0], 6), x[1]))


class Segmenter:
    def __init__(self, model: bytes) -> None:
        self.pieces = Pieces(model)
        self.remembered: dict[tuple[str, int], list[tuple[float, tuple[int, ...]]]] = {}
        self.points = 0

    def searched(self, segment: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """``Pieces.search``; results are remembered for a bounded number of code points."""
        found = self.remembered.get((segment, n))
        if found is None:
            if self.points > REMEMBERED:
                self.remembered.clear()
                self.points = 0
            found = self.remembered[segment, n] = self.pieces.search(segment, n)
            self.points += len(segment) * (n + 1)
        return found

    def __reduce__(self):
        raise TypeError("each worker makes its own from the model's bytes")

    def solve(self, segments: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """Ids and score of the best path of each segment, and the gap to the second."""
        ids: list[np.ndarray] = [None] * len(segments)
        score, gap = np.zeros(len(segments)), np.full(len(segments), np.inf)
        short: dict[int, list[int]] = defaultdict(list)
        for k, s in enumerate(segments):
            n = len(s)
            short[n if n <= 8 else 12 if n <= 12 else 16 if n <= 16 else LONG if n <= LONG else 0].append(k)
        for n, members in short.items():
            for at in range(0, len(members), 8192):
                part = members[at : at + 8192]
                alone = part if n == 0 else self._together(part, segments, n, ids, score, gap)
                for k in alone:
                    two = self.searched(segments[k], 2)
                    ids[k], score[k] = np.array(two[0][1], np.int32), two[0][0]
                    gap[k] = two[0][0] - two[1][0] if len(two) > 1 else np.inf
        return ids, score, gap

    def _together(self, part: list[int], segments: list[str], n: int, ids: list, score: np.ndarray, gap: np.ndarray) -> list[int]:
        """Solves segments of up to n characters; returns those it can't (byte pieces for
        characters of several bytes)."""
        p = self.pieces
        w = len(part)
        size = np.array([len(segments[k]) for k in part])
        code = np.ascontiguousarray(np.array([segments[k] for k in part], f"U{n}").view(np.uint32).reshape(w, n).T).astype(np.int64)
        char = p.of_code[code]
        known = char >= 0
        inside = np.arange(n)[:, None] < size
        deep = min(p.longest, n)
        s, piece = np.full((deep, n, w), -np.inf), np.full((deep, n, w), -1, np.int32)
        at = np.flatnonzero(known & inside)
        flat_char, flat_known, flat_inside = char.ravel(), known.ravel(), inside.ravel()
        state = p.first[flat_char[at]]
        s.reshape(deep, -1)[0, at], piece.reshape(deep, -1)[0, at] = p.score_at[state], p.piece_at[state]
        alive = state > 0
        at, state = at[alive], state[alive]
        for length in range(1, deep):
            then = at + length * w
            ok = then < n * w
            at, state, then = at[ok], state[ok], then[ok]
            ok = flat_known[then] & flat_inside[then]
            at, state, then = at[ok], state[ok], then[ok]
            if not len(at):
                break
            state = p.step(state, flat_char[then])
            ok = state >= 0
            at, state = at[ok], state[ok]
            s.reshape(deep, -1)[length, at], piece.reshape(deep, -1)[length, at] = p.score_at[state], p.piece_at[state]
        # characters without a piece of their own
        bare = inside & (piece[0] < 0)
        s[0][bare] = p.unknown
        narrow = bare & (code < 128)
        piece[0][narrow] = np.array(p.byte_id, np.int32)[code[narrow]]
        wide = (bare & (code >= 128)).any(axis=0)

        column = np.arange(w)
        before, step = np.full((n + 1, w), -np.inf), np.zeros((n + 1, w), np.int64)
        before[0] = 0
        for j in range(1, n + 1):
            best = before[j]
            for length in range(1, min(deep, j) + 1):
                new = before[j - length] + s[length - 1, j - length]
                better = new > best
                best[better] = new[better]
                step[j][better] = length
        behind = np.where(np.arange(n + 1)[:, None] == size, 0.0, -np.inf)
        for i in range(n - 1, -1, -1):
            for length in range(1, min(deep, n - i) + 1):
                np.maximum(behind[i], s[length - 1, i] + behind[i + length], out=behind[i])
        total = before[size, column]
        node, rows = size.copy(), []
        while (going := node > 0).any():
            length = np.where(going, step[node, column], 1)
            start = np.maximum(node - length, 0)
            rows.append(np.where(going, piece[length - 1, start, column], -1))
            s[(length - 1)[going], start[going], column[going]] = -np.inf  # leaves the other edges
            node = np.where(going, start, 0)
        second = np.full(w, -np.inf)
        for length in range(1, deep + 1):
            np.maximum(second, (before[: n - length + 1] + s[length - 1, : n - length + 1] + behind[length:]).max(axis=0), out=second)
        where = np.array(part)
        score[where], gap[where] = total, np.maximum(total - second, 0)
        path = np.array(rows, np.int32)[::-1].T
        for k, row, n_ids in zip(part, path, (path >= 0).sum(axis=1).tolist(), strict=True):
            ids[k] = row[len(row) - n_ids :]
        return where[wide].tolist()

    def segment(self, texts: list[str | None], n: int) -> Iterator[list[tuple[float, np.ndarray]]]:
        """The n best (score, ids) of each text, best first."""
        number: dict[str, int] = defaultdict(count().__next__)
        normal = [self.pieces.normalised(t) if t else "" for t in texts]
        split = [SEGMENT.findall(t) if self.pieces.divisible else [t] if t else [] for t in normal]
        which = [np.fromiter(map(number.__getitem__, ws), np.int64, len(ws)) for ws in split]
        segments = list(number)
        ids, score, gap = self.solve(segments)
        sizes = np.array([len(x) for x in ids], np.int64)
        starts = np.cumsum(sizes) - sizes
        flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
        for words in which:
            if not len(words):
                yield [(0.0, np.zeros(0, np.int32))]
                continue
            k = sizes[words]
            ends = np.cumsum(k)
            best = flat[np.repeat(starts[words] - (ends - k), k) + np.arange(ends[-1])]
            whole = float(score[words].sum())
            gaps = gap[words]
            if len(words) > n:
                limit = np.partition(gaps, n - 2)[n - 2] if n > 1 else -1.0
                places = np.flatnonzero(gaps <= limit)
                places = places[np.argsort(gaps[places], kind="stable")][: n - 1]
            else:
                places = np.arange(len(words))
            places = np.sort(places[np.isfinite(gaps[places])])
            ways = [self.searched(segments[words[x]], n) for x in places]
            drops = [[w[0][0] - s for s, _ in w] for w in ways]
            # partial sums of deviations, kept to the n smallest place by place
            sums: list[tuple[float, tuple[int, ...]]] = [(0.0, ())]
            for d in drops:
                sums = sorted(((a + b, (*x, y)) for (a, x), (y, b) in product(sums, enumerate(d))), key=lambda z: (round(z[0], 9), z[1]))[:n]
            out = []
            for drop, choice in sums:
                parts, at = [], 0
                for x, c, w in zip(places, choice, ways, strict=True):  # also where c is 0: of equal paths, the search has its own first
                    parts += [best[at : ends[x] - k[x]], np.array(w[c][1], np.int32)]
                    at = ends[x]
                out.append((whole - drop, np.concatenate([*parts, best[at:]]) if parts else best))
            yield out

    def decode(self, ids: np.ndarray) -> str:
        """The text of a segmentation, without a mark that the model puts before every text."""
        text = b"".join(map(self.pieces.text.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if self.pieces.prefixed and text[:1] == " " else text


@lru_cache(maxsize=2)
def _segmenter(model: bytes) -> Segmenter:
    return Segmenter(model)


def _model(spark: SparkSession, path: str):
    """The model's bytes (its size is the vocabulary's, not the corpus's), for the workers."""
    from pathlib import Path

    return spark.sparkContext.broadcast(Path(path).read_bytes())


def encode_nbest(docs: DataFrame, n: int = N_BEST, model: str = MODEL) -> DataFrame:
    """doc_id and segmentations: array of (score, ids), best first."""
    shared = _model(docs.sparkSession, model)
    kind = pa.list_(pa.struct([("score", pa.float64()), ("ids", pa.list_(pa.int32()))]))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = _segmenter(shared.value)
        for b in sliced(batches, 8192, TOGETHER):
            found = [[{"score": x, "ids": ids} for x, ids in best] for best in s.segment(b.column(1).to_pylist(), n)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, kind)], names=["doc_id", "segmentations"])

    key = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(encoded, f"doc_id {key}, segmentations array<struct<score:double,ids:array<int>>>")


def decode(encoded: DataFrame, ids: str = "ids", model: str = MODEL) -> DataFrame:
    """doc_id and text of the arrays in column ``ids``; null for null."""
    shared = _model(encoded.sparkSession, model)

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = _segmenter(shared.value)
        for b in sliced(batches):
            texts = [None if x is None else s.decode(np.array(x, np.int32)) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    key = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", ids).mapInArrow(decoded, f"doc_id {key}, text string")


def op6_piece_nbest(spark: SparkSession, sf_dir: str, n: int = N_BEST, model: str = MODEL) -> DataFrame:
    """Of each document's n best segmentations: score, pieces and digest of the ids; and
    whether the best decodes to the text."""
    docs = documents(spark, sf_dir)
    shared = _model(spark, model)
    kind = pa.list_(pa.struct([("score", pa.float64()), ("n_pieces", pa.int64()), ("ids_sha256", pa.string())]))

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = _segmenter(shared.value)
        for b in sliced(batches, 8192, TOGETHER):
            texts, rows, same = b.column(1).to_pylist(), [], []
            for t, best in zip(texts, s.segment(texts, n), strict=True):
                rows.append([{"score": round(x, 6), "n_pieces": len(ids), "ids_sha256": hashlib.sha256(ids.astype("<i4").tobytes()).hexdigest()} for x, ids in best])
                same.append(s.decode(best[0][1]) == (t or ""))
            pieces = [r[0]["n_pieces"] for r in rows]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pieces, pa.int64()), pa.array(same, pa.bool_()), pa.array(rows, kind)], names=["doc_id", "n_pieces", "round_trip", "segmentations"])

    key = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(digested, f"doc_id {key}, n_pieces long, round_trip boolean, segmentations array<struct<score:double,n_pieces:bigint,ids_sha256:string>>")
