"""Subword lattice: log-probability of words under all their segmentations.

Pieces are byte strings with log-probabilities. A word is read as a blank
followed by its bytes; every way to cut it into pieces counts, by the forward
recursion in log space, done for many words of similar length at once. Each
single byte is a piece, so every word has a segmentation.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BLANK = "▁".encode()
_BITS = 20
_P = np.uint64(0x100000001B3)
_MULTIPLIERS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93))
_BLOCK = 16_384
_EXACT = 24


def vocabulary(path: str) -> tuple[list[bytes], np.ndarray]:
    """Byte strings of the pieces of a sentencepiece model and their log-probabilities.

    Scores that sum to one as log-probabilities are taken as such. Others are
    ranks: a piece of rank r then gets a weight of 1 / (r + 2.7), Zipf's law.
    Bytes that are no piece, and byte pieces, rank behind all others.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found: dict[bytes, float] = {}
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i):
            continue
        text = model.id_to_piece(i).encode().replace(BLANK, b" ")
        if b" " not in text[1:]:
            found[text] = max(model.get_score(i), found.get(text, -np.inf))
    scores = np.array(list(found.values()))
    logs = scores - np.log(np.exp(scores).sum()) if 0.5 < np.exp(scores).sum() < 1.5 else -np.log(2.7 - scores)
    lowest = logs.min()
    pieces = list(found)
    extra = [bytes([b]) for b in range(256) if bytes([b]) not in found]
    logs = np.concatenate([logs, np.full(len(extra), lowest)])
    return pieces + extra, logs - np.log(np.exp(logs).sum())


def _hash(text: bytes) -> int:
    h = 0
    for b in text:
        h = (h * int(_P) + b + 1) & 0xFFFFFFFFFFFFFFFF
    return h


@dataclass
class Pieces:
    """Pieces by hash: those that begin a word (without their blank) and those inside."""

    keys: np.ndarray
    tables: list[list[np.ndarray]]
    blank: int
    longest: int

    @classmethod
    def of(cls, pieces: list[bytes]) -> Pieces:
        """Tables of slots; a piece whose slot is taken goes to the next table."""
        keys = np.zeros(len(pieces), np.uint64)
        tables: list[list[np.ndarray]] = []
        for begins in (True, False):
            left = [i for i, p in enumerate(pieces) if (p[:1] == b" " and len(p) > 1) == begins and p != b" "]
            own: list[np.ndarray] = []
            for i in left:
                keys[i] = _hash(pieces[i][1:] if begins else pieces[i])
            while left:
                multiplier = _MULTIPLIERS[len(own) % 3] + np.uint64(2 * (len(own) // 3))
                table = np.full(1 << _BITS, -1, np.int32)
                slots = ((keys[left] * multiplier) >> np.uint64(64 - _BITS)).astype(np.int64)
                rest = []
                for i, slot in zip(left, slots, strict=True):
                    if table[slot] < 0:
                        table[slot] = i
                    else:
                        rest.append(i)
                own.append(table)
                left = rest
            tables.append(own)
        return cls(keys, tables, pieces.index(b" "), max(len(p) for p in pieces))

    def find(self, h: np.ndarray, begins: bool) -> tuple[np.ndarray, np.ndarray]:
        """Rows whose string is a piece, and the pieces."""
        rows, which = [], []
        for turn, table in enumerate(self.tables[0 if begins else 1]):
            multiplier = _MULTIPLIERS[turn % 3] + np.uint64(2 * (turn // 3))
            got = table[(h * multiplier) >> np.uint64(64 - _BITS)]
            at = np.flatnonzero(got >= 0)
            at = at[self.keys[got[at]] == h[at]]
            rows.append(at)
            which.append(got[at])
        return np.concatenate(rows), np.concatenate(which)


def _groups(sizes: np.ndarray) -> list[np.ndarray]:
    """Words of equal length up to 24 bytes, and of similar length beyond, in blocks."""
    step = np.where(sizes <= _EXACT, sizes, _EXACT + np.ceil(np.log2(np.maximum(sizes, _EXACT + 1) / _EXACT) * 8))
    order = np.argsort(step, kind="stable")
    cuts = np.flatnonzero(np.diff(step[order])) + 1
    made = []
    for part in np.split(order, cuts):
        size = max(1, min(_BLOCK, (1 << 22) // max(1, int(sizes[part].max(initial=1)))))
        made += [part[i : i + size] for i in range(0, len(part), size)]
    return made


def word_logs(
    data: np.ndarray, starts: np.ndarray, ends: np.ndarray, pieces: Pieces, logs: np.ndarray, weight: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray | None]:
    """Natural log-probability of each word; with ``weight``, also the expected count of each piece."""
    out = np.zeros(len(starts))
    counts = np.zeros(len(logs)) if weight is not None else None
    sizes = ends - starts
    for rows in _groups(sizes):
        size = sizes[rows]
        width = int(size.max())
        inside = starts[rows][:, None] + np.arange(width)
        text = data[np.minimum(inside, len(data) - 1)]
        roll = np.zeros((width + 1, len(rows)), np.uint64)
        for i in range(width):
            roll[i + 1] = roll[i] * _P + text[:, i] + np.uint64(1)
        # column e of the table: the blank and the first e bytes are cut into pieces
        table = np.full((width + 1, len(rows)), -np.inf)
        table[0] = logs[pieces.blank]
        steps: list[tuple[np.ndarray, int, int, np.ndarray]] = []
        for end in range(1, width + 1):
            live = end <= size
            at, which = pieces.find(roll[end], True)
            at, which = at[live[at]], which[live[at]]
            table[end, at] = np.logaddexp(table[end, at], logs[which])
            steps.append((at, -1, end, which))
            for begin in range(max(0, end - pieces.longest), end):
                power = np.uint64(pow(int(_P), end - begin, 1 << 64))
                at, which = pieces.find(roll[end] - roll[begin] * power, False)
                if len(at):
                    table[end, at] = np.logaddexp(table[end, at], table[begin, at] + logs[which])
                    steps.append((at, begin, end, which))
        total = table[size, np.arange(len(rows))]
        out[rows] = total
        if counts is None:
            continue
        back = np.full((width + 1, len(rows)), -np.inf)
        back[size, np.arange(len(rows))] = 0
        share = weight[rows]
        for at, begin, end, which in reversed(steps):
            ahead = back[end, at] + logs[which]
            if begin >= 0:
                through = np.exp(table[begin, at] + ahead - total[at]) * share[at]
                back[begin, at] = np.logaddexp(back[begin, at], ahead)
            else:
                through = np.exp(ahead - total[at]) * share[at]
            counts += np.bincount(which, through, minlength=len(counts))
        through = np.exp(back[0] + logs[pieces.blank] - total) * share
        counts[pieces.blank] += through.sum()
    return out, counts
