"""Token counts by a tokenizer compiled to finite-state transducers.

Two deterministic machines count the tokens of a byte-level BPE tokenizer.

* The *splitter* reads character classes. It has thirteen states, and every transition says
  whether a pre-token starts at the last or at the present character. All its transition maps
  form a small monoid, so a chunk of text has one monoid element as its state map. Chunks are
  read side by side, their maps compose through a parallel prefix scan (doubling), and a
  second reading from the now known states emits the starts.
* The *counter* reads the bytes of a pre-token. Its state holds, for each suffix of what was
  read that can begin a token, the last token of the encoding up to that suffix and how many
  tokens stand there against here. Reading a byte selects the one token that is compatible
  with its predecessor; the transition carries the change of the number of tokens, so the sum
  along a pre-token is its token count. States are made when first met; when the table reaches
  ``MAX_STATES``, all that are not in use are dropped.

Both run in lock step over many chunks and pre-tokens. Rows stay in their partition: no
shuffle, and a text longer than a block is cut at a pre-token start, where the splitter is in
its first state whatever came before.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from shelfline.llm.common import ship, slices, text_view

#: Bound of the counter's table: so many states of 1 KB.
MAX_STATES = 100_000
#: Characters per block of one long text, and per chunk of the prefix scan.
BLOCK, CHUNK = 2 << 20, 256

# Character classes.
LETTER, FINAL, LETTER_R, LETTER_V, LETTER_E, LETTER_L, NUMBER, OTHER, SPACE, WHITE, QUOTE, END = range(12)
# States of the splitter. S_*: one white-space character, or several, by whether the last is a blank.
START, IN_LETTERS, IN_NUMBER, IN_OTHER, S_BLANK, S_WHITE, SS_BLANK, SS_WHITE, Q, Q_R, Q_V, Q_L, Q_DONE = range(13)
HERE, BEFORE = 1, 2
#: Rank of a merge that does not exist; tails that begin at most so many tokens get exact classes.
NEVER, FEW = 1 << 40, 60


def _plain(cls: int) -> int:
    """State after a character that begins a pre-token."""
    if cls <= LETTER_L:
        return IN_LETTERS
    return {NUMBER: IN_NUMBER, OTHER: IN_OTHER, SPACE: S_BLANK, WHITE: S_WHITE, QUOTE: Q, END: START}[cls]


def _step(state: int, cls: int) -> tuple[int, int]:
    """Next state, and where pre-tokens start."""
    if state in (Q_R, Q_V, Q_L):
        if cls == (LETTER_L if state == Q_L else LETTER_E):
            return Q_DONE, 0
        after, starts = _step(IN_LETTERS, cls)
        return after, starts | BEFORE
    if cls == END:
        return START, HERE
    if state in (S_BLANK, S_WHITE, SS_BLANK, SS_WHITE):
        if cls in (SPACE, WHITE):
            return (SS_BLANK if cls == SPACE else SS_WHITE), 0
        before = BEFORE if state in (SS_BLANK, SS_WHITE) else 0
        if state in (S_BLANK, SS_BLANK):
            return (IN_OTHER if cls == QUOTE else _plain(cls)), before
        return _plain(cls), before | HERE
    if state == Q:
        if cls == FINAL:
            return Q_DONE, 0
        if cls in (LETTER_R, LETTER_V, LETTER_L):
            return {LETTER_R: Q_R, LETTER_V: Q_V, LETTER_L: Q_L}[cls], 0
        state = IN_OTHER
    if state == IN_LETTERS and cls <= LETTER_L or state == IN_NUMBER and cls == NUMBER:
        return state, 0
    if state == IN_OTHER and cls in (OTHER, QUOTE):
        return IN_OTHER, 0
    return _plain(cls), HERE


class Splitter:
    """The compiled splitter: step and start tables, and the monoid of its state maps."""

    def __init__(self) -> None:
        steps = [[_step(s, c) for c in range(12)] for s in range(13)]
        self.next = np.array([[a for a, _ in row] for row in steps], np.uint8).ravel()
        self.starts = np.array([[b for _, b in row] for row in steps], np.uint8).ravel()
        one = tuple(range(13))
        letters = [tuple(int(self.next[s * 12 + c]) for s in range(13)) for c in range(12)]
        maps, place, at = [one], {one: 0}, 0
        while at < len(maps):
            for g in letters:
                x = tuple(g[s] for s in maps[at])
                if x not in place:
                    place[x] = len(maps)
                    maps.append(x)
            at += 1
        self.maps = np.array(maps, np.uint8)
        self.letter = np.array([place[g] for g in letters], np.uint16)
        # after[a, c]: first map a, then one character; then[a, b]: first a, then b.
        self.after = np.array([[place[tuple(g[s] for s in m)] for g in letters] for m in maps], np.uint16).ravel()
        self.then = np.array([[place[tuple(b[s] for s in a)] for b in maps] for a in maps], np.uint16)
        self.classes = _class_table()

    def chunk_states(self, cls: np.ndarray) -> np.ndarray:
        """State at the start of each column of ``cls`` (characters x chunks), by a prefix scan of the chunks' maps."""
        total = self.letter[cls[0]].astype(np.intp)
        for row in cls[1:]:
            total = self.after[total * 12 + row].astype(np.intp)
        hop = 1
        while hop < len(total):
            total[hop:] = self.then[total[:-hop], total[hop:]]
            hop *= 2
        first = np.full(len(total), START, np.intp)
        first[1:] = self.maps[total[:-1], START]
        return first

    def pretokens(self, cls: np.ndarray) -> np.ndarray:
        """True where a pre-token (or END) starts."""
        n = len(cls)
        chunks = -(-n // CHUNK)
        padded = np.full(chunks * CHUNK, END, np.uint8)
        padded[:n] = cls
        columns = np.ascontiguousarray(padded.reshape(chunks, CHUNK).T)
        state = self.chunk_states(columns)
        marks = np.empty((CHUNK, chunks), np.uint8)
        for j, row in enumerate(columns):
            at = state * 12 + row
            np.take(self.starts, at, out=marks[j])
            state = self.next[at].astype(np.intp)
        flat = np.ascontiguousarray(marks.T).ravel()
        begins = (flat & HERE) != 0
        begins[:-1] |= (flat[1:] & BEFORE) != 0
        return begins[:n]


#: White space outside of which nothing else is; fixed values of the Unicode property White_Space.
WHITE_SPACE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@lru_cache(maxsize=1)
def _class_table() -> np.ndarray:
    """Class of every code point."""
    import regex

    table = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for pattern, cls in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER)):
        for m in regex.finditer(pattern, every):
            first, last = ord(every[m.start()]), ord(every[m.end() - 1])
            table[first : last + 1] = cls
    table[WHITE_SPACE] = WHITE
    for chars, cls in (("stmd", FINAL), ("r", LETTER_R), ("v", LETTER_V), ("e", LETTER_E), ("l", LETTER_L), (" ", SPACE), ("'", QUOTE)):
        table[[ord(c) for c in chars]] = cls
    return table


def _byte_letters() -> dict[str, int]:
    """The printable letters by which byte-level vocabularies write bytes: printable Latin-1 as itself, the others from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def check_spec(spec: dict) -> None:
    """Raise ValueError for a tokenizer file that counts by other rules than those compiled here.

    Known are byte-level BPE files with the usual splitter, without normalizer, and with added
    tokens that are matched as they stand. Truncation, padding and post-processing play no part in counts.
    """
    cut, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
    wrong = []
    if spec.get("normalizer") is not None:
        wrong.append("normalizer")
    if cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True):
        wrong.append("pre_tokenizer")
    if model.get("type", "BPE") != "BPE":
        wrong.append("model")
    options = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
    wrong += [f"model.{o}" for o in options if model.get(o)]
    flags = ("single_word", "lstrip", "rstrip", "normalized")
    wrong += [f"added token {t.get('content')!r}" for t in spec.get("added_tokens") or [] if any(t.get(f) for f in flags)]
    if wrong:
        raise ValueError(f"unknown settings of the tokenizer file: {', '.join(wrong)}")


class Counter:
    """The counter, compiled state by state.

    Two tokens can stand side by side if no merge across their border would have come before
    the merges that formed them. A token's *spine* lists the pieces that stood at its border
    while it was formed, each with the rank of the merge that ended it; walking two spines in
    step answers the question without encoding anything.

    A state is a set of (tail, class of the last token, tokens there against here): tails are
    the suffixes of the bytes read that begin a token. Last tokens that admit the same tokens
    beginning with the tail are one class, and a tail that admits none is left out.
    """

    def __init__(self, tokenizer: bytes, max_states: int = MAX_STATES) -> None:
        spec = json.loads(tokenizer)
        check_spec(spec)
        letters = _byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        merges = [tuple(map(raw, m.split(" ") if isinstance(m, str) else m)) for m in spec["model"]["merges"]]
        self.specials = sorted((t["content"].encode() for t in spec.get("added_tokens", [])), key=len, reverse=True)
        self.rank: dict[tuple[bytes, bytes], int] = {}
        self.parts: dict[bytes, tuple[bytes, bytes, int]] = {}
        for i, (a, b) in enumerate(merges):
            self.rank.setdefault((a, b), i)
            self.parts.setdefault(a + b, (a, b, i))
        self.tokens = {bytes([b]) for b in range(256)} | set(self.parts)
        self.longer: dict[bytes, list[bytes]] = {}
        for t in self.tokens:
            for i in range(len(t)):
                self.longer.setdefault(t[:i], []).append(t)
        self.lefts = {a for a, _ in self.rank}
        self.max_states = max_states
        self.spines: dict[tuple[bytes, int], tuple[tuple[bytes, int], ...]] = {}
        self.classes: dict[tuple, int] = {}
        self.class_of: dict[tuple[bytes, bytes | None], int] = {}
        self.member: list[bytes | None] = []
        self.front = ((b"", self._class(b"", None), 0),)
        self.restart(np.zeros(0, np.int64), [])

    def restart(self, live: np.ndarray, keys: list[tuple]) -> np.ndarray:
        """Drop all states but the first and the live ones; their new numbers."""
        old = [keys[s] for s in live.tolist()]
        self.number: dict[tuple, int] = {}
        self.keys: list[tuple] = []
        self.table = np.full(256 * 1024, -1, np.int32)
        self.state(self.front)
        return np.array([self.state(k) for k in old], np.int64)

    def bounded(self, state: np.ndarray) -> np.ndarray:
        """The states' numbers, after a restart where the table has reached its bound; it keeps what is in use."""
        live, place = np.unique(state, return_inverse=True)
        if len(self.keys) <= max(self.max_states, 2 * len(live)):
            return state
        return self.restart(live, self.keys)[place]

    def state(self, key: tuple) -> int:
        if key not in self.number:
            self.number[key] = len(self.keys)
            self.keys.append(key)
            if len(self.keys) * 256 > len(self.table):
                self.table = np.concatenate([self.table, np.full(len(self.table), -1, np.int32)])
        return self.number[key]

    def spine(self, token: bytes, side: int) -> tuple[tuple[bytes, int], ...]:
        """Pieces of ``token`` at its left (0) or right (1) border, first to last, with the rank that ended each."""
        known = self.spines.get((token, side))
        if known is None:
            out, piece, end = [], token, NEVER
            while True:
                out.append((piece, end))
                if len(piece) == 1:
                    break
                *parts, end = self.parts[piece]
                piece = parts[side]
            known = self.spines[token, side] = tuple(reversed(out))
        return known

    def compatible(self, last: bytes | None, token: bytes) -> bool:
        """Whether ``token`` can follow ``last`` (None: stand at the front)."""
        if last is None:
            return True
        left, right = self.spine(last, 1), self.spine(token, 0)
        i = j = 0
        while True:
            (a, a_end), (b, b_end) = left[i], right[j]
            # At equal ranks the merge further left comes first.
            if self.rank.get((a, b), NEVER) < a_end and self.rank[a, b] <= b_end:
                return False
            if a_end == NEVER and b_end == NEVER:
                return True
            if a_end <= b_end:
                i += 1
            else:
                j += 1

    def _class(self, tail: bytes, last: bytes | None) -> int:
        """Class of ``last`` before tokens that begin with ``tail``; -1 where none can follow."""
        known = self.class_of.get((tail, last))
        if known is None:
            longer = self.longer.get(tail, ())
            if last is not None and len(longer) > FEW:
                about = (tail, tuple(x for x in self.spine(last, 1) if x[0] in self.lefts))
            else:
                about = (tail, tuple(t for t in longer if self.compatible(last, t)))
            if not about[1] and len(longer) <= FEW:
                known = -1
            else:
                known = self.classes.setdefault(about, len(self.member))
                if known == len(self.member):
                    self.member.append(last)
            self.class_of[tail, last] = known
        return known

    def make(self, state: int, byte: int) -> None:
        """Add the transition: the one token that ends here and fits its predecessor."""
        key, b = self.keys[state], bytes([byte])
        for tail, kind, count in reversed(key):
            if tail + b in self.tokens and self.compatible(self.member[kind], tail + b):
                token, change = tail + b, count + 1
                break
        kept = [(b"", self._class(b"", token), 0)]
        for tail, kind, count in key:
            if tail + b in self.longer:
                narrower = self._class(tail + b, self.member[kind])
                if narrower >= 0:
                    kept.append((tail + b, narrower, count - change))
        after = self.state(tuple(kept))
        self.table[state * 256 + byte] = after << 8 | (change + 128)

    def counts(self, raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Tokens of each pre-token raw[start : start + length]."""
        order = np.argsort(-lengths, kind="stable")
        begin, size = starts[order], lengths[order]
        total = np.zeros(len(order), np.int64)
        longest = int(size[0]) if len(size) else 0
        active = np.searchsorted(-size, -np.arange(longest), side="left")
        state, j = np.zeros(len(order), np.int64), 0
        while j < longest:
            n = int(active[j])
            if n < 6:
                break
            at = (state[:n] << 8) + raw[begin[:n] + j]
            got = self.table[at]
            if got.min() < 0:
                if len(self.keys) > self.max_states:
                    state[:n] = self.bounded(state[:n])
                    at = (state[:n] << 8) + raw[begin[:n] + j]
                    got = self.table[at]
                for x in np.unique(at[got < 0]).tolist():
                    self.make(x >> 8, x & 255)
                got = self.table[at]
            total[:n] += (got & 255) - 128
            state[:n] = got >> 8
            j += 1
        if j < longest:  # the few longest, one by one
            for k in range(int(active[j])):
                now, sum_ = int(state[k]), 0
                for byte in raw[begin[k] + j : begin[k] + size[k]].tolist():
                    got = int(self.table[now << 8 | byte])
                    if got < 0:
                        if len(self.keys) > self.max_states:
                            state[k] = now
                            state[k : int(active[j])] = self.bounded(state[k : int(active[j])])
                            now = int(state[k])
                        self.make(now, byte)
                        got = int(self.table[now << 8 | byte])
                    sum_ += (got & 255) - 128
                    now = got >> 8
                total[k] += sum_
        out = np.empty(len(order), np.int64)
        out[order] = total
        return out


class TokenCounter:
    """Splitter and counter of one tokenizer file."""

    def __init__(self, tokenizer: bytes, max_states: int = MAX_STATES) -> None:
        self.splitter, self.counter = Splitter(), Counter(tokenizer, max_states)

    def count(self, texts: pa.Array) -> np.ndarray:
        """Tokens of every text (null: none), special strings counting as one token."""
        raw, offsets = text_view(texts)
        if any(s in raw.tobytes() for s in self.counter.specials):
            return np.array([self._with_specials(raw[a:b].tobytes()) for a, b in zip(offsets, offsets[1:])], np.int64)
        return self._count(raw, offsets)

    def _with_specials(self, text: bytes) -> int:
        pieces, specials, at = [], 0, 0
        while True:
            found = min(((text.find(s, at), -len(s)) for s in self.counter.specials if text.find(s, at) >= 0), default=None)
            if found is None:
                break
            pieces.append(text[at : found[0]])
            specials, at = specials + 1, found[0] - found[1]
        pieces.append(text[at:])
        sizes = np.cumsum([0, *map(len, pieces)])
        return specials + int(self._count(np.frombuffer(b"".join(pieces), np.uint8), sizes).sum())

    def _count(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if not len(raw):
            return np.zeros(len(offsets) - 1, np.int64)
        if len(offsets) == 2 and len(raw) > 2 * BLOCK:
            return np.array([self._long(raw)], np.int64)
        tokens, first = self._pretoken_counts(raw, offsets)
        sums = np.concatenate([[0], np.cumsum(tokens)])
        places = np.searchsorted(first, offsets)
        return sums[places[1:]] - sums[places[:-1]]

    def _long(self, raw: np.ndarray) -> int:
        """One long text, block by block; a block ends where a pre-token starts for certain."""
        total, at, size = 0, 0, BLOCK
        while at < len(raw):
            end = min(len(raw), at + size)
            while end < len(raw) and raw[end] & 0xC0 == 0x80:
                end -= 1
            piece = raw[at:end]
            tokens, first = self._pretoken_counts(piece, np.array([0, len(piece)]))
            if end < len(raw):
                # What follows the block can change only the last pre-tokens of it.
                sure = np.searchsorted(first, len(piece) - 16)
                if sure < 2:
                    size *= 2
                    continue
                total, at, size = total + int(tokens[: sure - 1].sum()), at + int(first[sure - 1]), BLOCK
            else:
                total, at = total + int(tokens.sum()), end
        return total

    def _pretoken_counts(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        place = np.flatnonzero((raw & 0xC0) != 0x80)  # byte of each character
        ends = np.searchsorted(place, offsets[1:])
        cls = np.insert(self.splitter.classes[points], ends, END)
        begins = self.splitter.pretokens(cls)
        begins &= cls != END
        # An END is inserted behind each text: character i of text t stands at i + t.
        chars = np.flatnonzero(begins)
        chars -= np.searchsorted(ends + np.arange(len(ends)), chars)
        first = place[chars]
        # A pre-token ends at the next start; the last of a text, at the text's end, where the next one starts.
        lengths = np.diff(np.append(first, len(raw)))
        return self.counter.counts(raw, first, lengths), first


@lru_cache(maxsize=2)
def _counter(tokenizer: bytes) -> TokenCounter:
    return TokenCounter(tokenizer)


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 512, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) per row, as the tokenizer file ``tokenizer`` counts whole texts.

    Null and empty texts have no bytes and no tokens. Repeated rows and equal or null keys are
    counted row by row; other columns are ignored, whatever their names. An empty table gives
    an empty result. The file (a byte-level BPE in JSON) is read on the driver and broadcast:
    its size does not depend on the data.
    """
    spark = docs.sparkSession
    ship(spark)
    spec = spark.sparkContext.broadcast(Path(tokenizer).read_bytes())
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(spec.value)
        for batch in slices(batches, "text"):
            n = counter.count(batch.column("text"))
            sizes = np.diff(text_view(batch.column("text"))[1])
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array(sizes, pa.int64()), pa.array(n, pa.int64()), pa.array(n > limit)],
                ["key", "n_bytes", "n_tokens", "over_limit"],
            )

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    out = rows.mapInArrow(run, f"key {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
    return out.withColumnRenamed("key", key)
