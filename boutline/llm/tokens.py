"""Token counts of a sentencepiece BPE vocabulary by rank-synchronous array merging.

Distinct pre-tokens of a slice of texts are held as one ragged numpy array of piece ids. In every
round each pre-token applies its lowest-rank pair, all pre-tokens at once, until none has a pair in
the vocabulary; what survives is counted. Characters without a piece count their UTF-8 bytes."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from boutline.llm.common import text_slices

CACHED_PARTS, CACHED_LENGTH = 300_000, 64
NONE = np.int64(1) << 40
BAR = "▁"
FILTER_BITS = 22


def _slot(key: np.ndarray) -> np.ndarray:
    return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - FILTER_BITS)


class PieceCounter:
    """Counts pieces of pre-tokens. A part is the text after a space, or after an artificial space
    in front of a line feed: `w` stands for the pre-token of a space and w, `\\nw` for a line feed
    followed by w without a space."""

    def __init__(self, model_path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        size = model.get_piece_size()
        ids = {
            model.id_to_piece(i): i
            for i in range(size)
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
        }
        scores = sorted({model.get_score(i) for i in ids.values()}, reverse=True)
        ranks = {score: rank for rank, score in enumerate(scores)}
        self.id_of = np.full(0x110000, -1, np.int64)
        for piece, i in ids.items():
            if len(piece) == 1:
                self.id_of[ord(piece)] = i
        pairs, inside = {}, set()
        for piece, i in ids.items():
            rank = ranks[model.get_score(i)]
            for cut in range(1, len(piece)):
                left, right = ids.get(piece[:cut]), ids.get(piece[cut:])
                if left is not None and right is not None:
                    pairs[left << 20 | right] = (rank, i)
            inside.update(ord(a) << 21 | ord(b) for a, b in zip(piece, piece[1:]))
        keys = np.array(sorted(pairs), np.int64)
        self.keys = np.append(keys, NONE)
        self.rank = np.append(np.array([pairs[k][0] for k in keys.tolist()], np.int64), NONE)
        self.made = np.append(np.array([pairs[k][1] for k in keys.tolist()], np.int64), -1)
        self.maybe = np.zeros(1 << FILTER_BITS, bool)
        self.maybe[_slot(keys)] = True
        # Neighbouring characters that no piece contains are never merged across. A wrong hit of
        # the hashed set only leaves two sequences together.
        self.inside = np.zeros(1 << FILTER_BITS, bool)
        self.inside[_slot(np.array(sorted(inside), np.int64))] = True
        self.known: dict[str, int] = {}
        self.long: list[str] = []

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Index of each pair in the table, the last one if it is none."""
        none = len(self.keys) - 1
        key = left << 20 | right  # negative if either is no piece
        out = np.full(len(key), none, np.int64)
        likely = np.flatnonzero((key >= 0) & self.maybe[_slot(key)])
        at = np.searchsorted(self.keys, key[likely])
        out[likely] = np.where(self.keys[at] == key[likely], at, none)
        return out

    def pieces(self, segments: list[str]) -> np.ndarray:
        """Pieces in each segment (already with bars for spaces)."""
        none = len(self.keys) - 1
        lengths = np.fromiter(map(len, segments), np.int64, len(segments))
        chars = np.frombuffer("".join(segments).encode("utf-32-le"), np.uint32).astype(np.int64)
        symbols = self.id_of[chars]
        owner = np.repeat(np.arange(len(segments)), lengths)
        size_of = np.where(symbols >= 0, 1, 1 + (chars > 0x7F) + (chars > 0x7FF) + (chars > 0xFFFF))
        counts = np.bincount(owner, weights=size_of, minlength=len(segments)).astype(np.int64)
        # Sequences: cut segments wherever no piece can stretch across.
        joined = (owner[:-1] == owner[1:]) & self.inside[_slot(chars[:-1] << 21 | chars[1:])]
        sequence = np.concatenate([[0], np.cumsum(~joined)]) if len(symbols) else np.zeros(0, np.int64)
        # The pair that starts at each symbol, none at the end of a sequence.
        pair = np.full(len(symbols), none, np.int64)
        inner = np.flatnonzero(joined)
        pair[inner] = self._pairs(symbols[inner], symbols[inner + 1])
        while len(symbols):
            rank = self.rank[pair]
            first = np.concatenate([[0], np.flatnonzero(sequence[1:] != sequence[:-1]) + 1])
            low = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, len(symbols))))
            # Finished sequences leave; their symbols are in `counts` already.
            active = low < NONE
            symbols, sequence, owner, low, rank, pair = (x[active] for x in (symbols, sequence, owner, low, rank, pair))
            if not len(symbols):
                break
            chosen = self._leftmost_free(rank == low, sequence)
            after, new_pair, kept, early = self._apply(symbols, sequence, pair, low, chosen)
            if early is not None:
                # A merge made a pair that comes before the next occurrence: such a sequence takes
                # only its first occurrence in this round.
                careful = np.zeros(int(sequence[-1]) + 1, bool)
                careful[early] = True
                start = np.concatenate([[True], sequence[1:] != sequence[:-1]])
                total = np.cumsum(chosen)
                base = (total - chosen)[start][np.cumsum(start) - 1]
                chosen &= ~careful[sequence] | (total - base == 1)
                after, new_pair, kept, _ = self._apply(symbols, sequence, pair, low, chosen)
            counts -= np.bincount(owner[chosen], minlength=len(segments))
            symbols, pair, sequence, owner = after, new_pair, sequence[kept], owner[kept]
        return counts

    def _apply(self, symbols, sequence, pair, low, chosen):
        """Merge the chosen pairs: symbols, their pairs, which places stay, and the sequences in
        which a new pair does not come after the pair just merged (None: none)."""
        kept = ~np.concatenate([[False], chosen[:-1]])
        after = np.where(chosen, self.made[pair], symbols)[kept]
        new, seq = chosen[kept], sequence[kept]
        out = pair[kept]
        same = seq[:-1] == seq[1:]
        out[np.flatnonzero(new[:-1] & ~same)] = len(self.keys) - 1
        if new[-1]:
            out[-1] = len(self.keys) - 1
        near = np.flatnonzero((new[:-1] | new[1:]) & same)
        out[near] = self._pairs(after[near], after[near + 1])
        early = near[self.rank[out[near]] <= low[kept][near]]
        return after, out, kept, seq[early] if len(early) else None

    @staticmethod
    def _leftmost_free(hit: np.ndarray, sequence: np.ndarray) -> np.ndarray:
        """Of hits in neighbouring places (of one sequence), every second one from the left."""
        start = hit & ~np.concatenate([[False], hit[:-1] & (sequence[1:] == sequence[:-1])])
        place = np.arange(len(hit))
        since = place - np.maximum.accumulate(np.where(start, place, 0))
        return hit & (since % 2 == 0)

    def learn(self, parts: set[str]) -> dict[str, int]:
        """Counts of all parts known so far, these among them."""
        if len(self.known) > CACHED_PARTS:
            self.known = {}
        new = list(parts.difference(self.known))
        segments = [p[1:] if p[:1] == "\n" else BAR + p for p in new]
        counts = self.pieces([s.replace(" ", BAR) for s in segments]).tolist() if new else []
        self.long = [p for p in new if len(p) > CACHED_LENGTH]
        self.known.update((p, c + (p[:1] == "\n")) for p, c in zip(new, counts))
        return self.known

    def count(self, texts: list[str]) -> list[int]:
        rows = [parts_of(t) for t in texts]
        counts = self.learn(set().union(*rows))
        out = [sum(map(counts.__getitem__, row)) for row in rows]
        for p in self.long:
            del counts[p]
        self.long = []
        return out


SEGMENTS = re.compile(r" *[^ \n]+| +|\n")


def parts_of(text: str) -> list[str]:
    """Pre-tokens of a text, each as a part (see `PieceCounter`)."""
    if not text:
        return []
    text = " " + text.replace(BAR, " ")
    if "  " not in text and " \n" not in text and text[-1] != " ":
        return text.replace("\n", " \n").split(" ")[1:]
    return [s[1:] if s[0] == " " else s if s == "\n" else "\n" + s for s in _joined_breaks(SEGMENTS.findall(text))]


def _joined_breaks(segments: list[str]) -> Iterator[str]:
    """A segment without a space in front follows a line feed: the two become one part."""
    pending = False
    for s in segments:
        if s == "\n":
            if pending:
                yield "\n"
            pending = True
        elif s[0] != " ":
            pending = False
            yield s
        else:
            if pending:
                yield "\n"
            pending = False
            yield s
    if pending:
        yield "\n"


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096) -> DataFrame:
    """Per row of `docs` (doc_id, text): doc_id, n_bytes, n_tokens, over_limit.

    NULL and empty texts have no bytes and no tokens. Repeated rows are counted each; other
    columns of `docs` are ignored; an empty table gives an empty result. Texts are taken whole,
    whatever their length; memory follows one slice of texts and a bounded cache."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = None
        for part in text_slices(batches):
            counter = counter or PieceCounter(model_path)
            texts = pc.fill_null(part.column("text"), "")
            n = pa.array(counter.count(texts.to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pc.cast(pc.binary_length(texts), pa.int64()), n, pc.greater(n, limit)],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    rows = docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "CAST(text AS STRING) AS text")
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
