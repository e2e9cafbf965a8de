"""Token counts by a compiled finite-state tokenizer.

A byte-pair tokenizer with its pre-splitting pattern is a finite transducer:
what has been read of the current piece matters only through the positions
from which a vocabulary entry can still grow, the token ending at each, and
how many tokens have been spent since.  ``Transducer`` determinises this on
demand.  Each transition (state, code point) carries the change in the number
of emitted tokens, so the count of a text is the sum of the weights along its
path and no token is ever built.

Texts are cut into chunks.  All chunks advance in lockstep, one numpy gather a
character; each chunk has a state map (start state -> end state and count).
It is constant where the chunk begins at a blank after a non-blank, and else
taken at the states that short runs from before the chunk end in.  The maps of
a text compose by a parallel prefix scan (``composed``).  Where a map isn't
known at a state that is needed, it is taken there and the scan repeated.

The automaton is compiled as texts need it.  It is dropped once it has more
than ``MOST_STATES`` states; a text in work keeps only its present state, so
counts don't depend on it.  Texts are fed in parts of ``PART`` characters, or
fewer while the automaton grows fast.

Results: a null text has a null count, an empty text 0.  Rows are kept one to
one, repeated rows and ids included; texts of any length are counted whole, an
empty table gives an empty one, and other columns of the input are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import only
from .textops import begins, keeps, slices

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Entries growing from a position are listed, to merge equal states, where there are no more than this.
FEW = 6
CHUNK = 1024
#: The compiled automaton is dropped when it has more states than this.
MOST_STATES = 200_000
#: Entries of each table of results that can be found again; it is emptied when it has so many.
MOST_FOUND = 50_000
#: Characters that are counted between two looks at the automaton's size; an eighth while it grows by more than GROWING states.
PART = 1 << 22
#: Bytes of text that are counted at once; scratch memory is some 30 times as much.
SLICE = 2_000_000
GROWING = 20_000
#: A transition's value: the next state above, the weight plus an offset in the low bits.
_BITS, _OFFSET = 13, 1 << 12
_HASH = 0x9E3779B97F4A7C15
_CLASS = [("W", regex.compile(r"\s")), ("L", regex.compile(r"\p{L}")), ("N", regex.compile(r"\p{N}"))]


def noted(found: dict, key: int, value: object) -> None:
    """Add a result to a table of bounded size."""
    if len(found) >= MOST_FOUND:
        found.clear()
    found[key] = value


class Merges:
    """The byte-pair part: a lazily determinised automaton over the bytes of one piece."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.base = 1 + max(i for b, i in ranks.items() if len(b) == 1)
        if any(len(b) > 1 for b, i in ranks.items() if i < self.base):
            raise ValueError("single bytes must have the lowest ranks")
        self.split: dict[int, tuple[int, int]] = {}
        self.child: list[dict[int, int]] = [{}]
        self.token = [-1]
        for b, i in ranks.items():
            n = 0
            for c in b:
                m = self.child[n].get(c)
                if m is None:
                    m = self.child[n][c] = len(self.child)
                    self.child.append({})
                    self.token.append(-1)
                n = m
            self.token[n] = i
        self.below: dict[int, frozenset | None] = {}
        self.forget()

    def forget(self) -> None:
        """Drop what was compiled."""
        self.pair: dict[int, bool] = {}
        self.open: dict[int, tuple | None] = {}
        self.views: dict[tuple, tuple] = {}
        first = (0, self.view(-1), 0)  # of each position: its node, its view, the tokens spent since
        self.states = [first]
        self.index = {first: 0}
        self.next: dict[int, tuple[int, int]] = {}

    def view(self, *parts: int | frozenset) -> tuple:
        """The one tuple of these parts: states share equal views."""
        return self.views.setdefault(parts, parts)

    def fits(self, a: int, b: int) -> bool:
        """Whether the merges leave token a beside token b as they are.

        Merges are undone at the boundary, the latest first.  The two parts
        that then meet must not merge sooner than the merge just undone; among
        equal ranks the one further left comes first.
        """
        key = a << 32 | b
        ok = self.pair.get(key)
        if ok is None:
            x, y, limit, ok = a, b, 1 << 60, True
            while True:
                if self.ranks.get(self.bytes_of[x] + self.bytes_of[y], limit) < limit:
                    ok = False
                    break
                if x > y:
                    if x < self.base:
                        break
                    limit, x = x, self.halves(x)[1]
                else:
                    if y < self.base:
                        break
                    limit, y = y + 1, self.halves(y)[0]
            noted(self.pair, key, ok)
        return ok

    def halves(self, token: int) -> tuple[int, int]:
        """The two tokens whose merge made this one."""
        got = self.split.get(token)
        if got is None:
            data = self.bytes_of[token]
            parts = [data[i : i + 1] for i in range(len(data))]
            while len(parts) > 2:
                _, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            got = self.split[token] = self.ranks[parts[0]], self.ranks[parts[1]]
        return got

    def grown(self, node: int) -> frozenset | None:
        """The tokens strictly below a trie node, None if they are more than FEW."""
        if node not in self.below:
            out, todo = [], list(self.child[node].values())
            while todo and len(out) <= FEW:
                m = todo.pop()
                if self.token[m] >= 0:
                    out.append(self.token[m])
                todo.extend(self.child[m].values())
            self.below[node] = None if len(out) > FEW else frozenset(out)
        return self.below[node]

    def outlook(self, node: int, last: int) -> tuple | None:
        """What a position allows yet: the last token before it, or the few tokens that may end there."""
        key = node << 32 | last + 1
        got = self.open.get(key, self)
        if got is self:
            if not self.child[node]:
                got = None
            elif last < 0 or (below := self.grown(node)) is None:
                got = self.view(last)
            else:
                ok = frozenset(w for w in below if self.fits(last, w))
                got = self.view(-2, ok) if ok else None
            noted(self.open, key, got)
        return got

    def step(self, state: int, byte: int) -> tuple[int, int]:
        """Next state and the change in the number of tokens."""
        found = self.next.get(state << 8 | byte)
        if found:
            return found
        reached, token, spent = [], -1, 0
        parts = iter(self.states[state])
        for node, view, used in zip(parts, parts, parts):
            m = self.child[node].get(byte)
            if m is None:
                continue
            w = self.token[m]
            if w >= 0 and token < 0 and (w in view[1] if view[0] == -2 else view[0] < 0 or self.fits(view[0], w)):
                token, spent = w, used
            reached.append((m, view, used))
        delta, out = 1 - spent, []
        for m, view, used in reached:
            if view[0] == -2:
                left = view[1] & self.grown(m)
                view = self.view(-2, left) if left else None
            else:
                view = self.outlook(m, view[0])
            if view is not None:
                out += m, view, used + delta
        out += 0, self.view(token), 0
        key = tuple(out)
        to = self.index.get(key)
        if to is None:
            to = self.index[key] = len(self.states)
            self.states.append(key)
        noted(self.next, state << 8 | byte, (to, delta))
        return to, delta

    def run(self, state: int, data: bytes) -> tuple[int, int]:
        total = 0
        for b in data:
            state, d = self.step(state, b)
            total += d
        return state, total


class Transducer:
    """The pre-splitting pattern over the merges, as one automaton over code points.

    Weights are differences of "tokens if the text ended here", so a path's
    sum needs no final correction.
    """

    def __init__(self, vocabulary: bytes):
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line)}
        self.merges = Merges(ranks)
        self.kind: dict[int, str] = {}
        self.forget()

    def forget(self, kept: int = 0) -> int:
        """Drop what was compiled but for one state; its new number."""
        state = self.states[kept] if kept else ("S",)
        below = self.merges.states[state[1]] if state[0] in "WLNO" else None
        self.merges.forget()
        if below is not None:
            if below not in self.merges.index:
                self.merges.index[below] = len(self.merges.states)
                self.merges.states.append(below)
            state = (state[0], self.merges.index[below], *state[2:])
        self.states: list[tuple] = [("S",)]
        self.index: dict[tuple, int] = {("S",): 0}
        self._table(1 << 18)
        if state not in self.index:
            self.index[state] = len(self.states)
            self.states.append(state)
        return self.index[state]

    def crowded(self) -> bool:
        return len(self.states) > MOST_STATES or len(self.merges.states) > MOST_STATES or self.filled > 20 * MOST_STATES

    def _table(self, size: int) -> None:
        self.keys = np.full(size, -1, np.int64)
        self.vals = np.zeros(size, np.int64)
        self.bits = 64 - size.bit_length() + 1
        self.shift = np.uint64(self.bits)
        self.filled = 0

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(_HASH)) >> self.shift).view(np.int64)

    def class_of(self, cp: int) -> str:
        if cp not in self.kind:
            c = chr(cp)
            self.kind[cp] = next((k for k, p in _CLASS if p.match(c)), "O")
        return self.kind[cp]

    def enter(self, cp: int, blank: bool) -> tuple[tuple, int]:
        """Begin a piece with this character, after a blank of its own if asked."""
        data, kind = chr(cp).encode("utf-8", "surrogatepass"), self.class_of(cp)
        if kind == "W":
            return ("W", 0, cp), self.merges.run(0, data)[1]
        state, n = self.merges.run(0, b" " + data if blank else data)
        return (("A",) if cp == 39 and not blank else (kind, state)), n

    def move(self, state: tuple, cp: int) -> tuple[tuple, int]:
        run, data = self.merges.run, chr(cp).encode("utf-8", "surrogatepass")
        at, kind = state[0], self.class_of(cp)
        if at == "S":
            return self.enter(cp, False)
        if at == "W":  # all blanks but the last one are a piece; the last may join what follows
            before, last = state[1], chr(state[2]).encode()
            full, d = run(before, last)
            if kind == "W":
                return ("W", full, cp), run(full, data)[1]
            to, n = self.enter(cp, last == b" ")
            return to, n - d + (0 if last == b" " else run(0, last)[1])
        if at == "A":  # an apostrophe that may begin a contraction
            c = chr(cp)
            if c in "stmd":
                return ("S",), run(0, b"'" + data)[1] - run(0, b"'")[1]
            if c in "rvl":
                return ("B", cp), run(0, data)[1]
            if kind == "O":
                s, d = run(run(0, b"'")[0], data)
                return ("O", s), d
            return self.enter(cp, False)
        if at == "B":
            a = chr(state[1]).encode()
            if chr(cp) == {"r": "e", "v": "e", "l": "l"}[chr(state[1])]:
                return ("S",), run(0, b"'" + a + data)[1] - run(0, b"'")[1] - run(0, a)[1]
            return self.move(("L", run(0, a)[0]), cp)
        if kind == at:
            s, d = run(state[1], data)
            return (kind, s), d
        return self.enter(cp, False)

    def compile(self, key: int) -> int:
        """Add the transition of one (state, code point) to the table."""
        to, d = self.move(self.states[key >> 21], key & 0x1FFFFF)
        i = self.index.get(to)
        if i is None:
            i = self.index[to] = len(self.states)
            self.states.append(to)
        if self.filled * 4 > len(self.keys):
            keys, vals = self.keys, self.vals
            self._table(2 * len(keys))
            old = keys >= 0
            for k, v in zip(keys[old].tolist(), vals[old].tolist()):
                self._put(k, v)
        v = (i << _BITS) + d + _OFFSET
        self._put(key, v)
        return v

    def _put(self, key: int, val: int) -> None:
        s = ((key * _HASH) & 0xFFFFFFFFFFFFFFFF) >> self.bits
        while self.keys[s] != -1:
            s = (s + 1) & (len(self.keys) - 1)
        self.keys[s], self.vals[s] = key, val
        self.filled += 1

    def look(self, key: np.ndarray) -> np.ndarray:
        slot = self._slot(key)
        found = self.keys[slot]
        val = self.vals[slot]
        bad = np.flatnonzero(found != key)
        while len(bad):
            vacant = found[bad] == -1
            if vacant.any():
                new: dict[int, int] = {}
                for j in bad[vacant].tolist():
                    k = int(key[j])
                    if k not in new:
                        new[k] = self.compile(k)
                    val[j] = new[k]
                bad = bad[~vacant]
                slot[bad] = self._slot(key[bad]) - 1  # the table may have been rebuilt
            slot[bad] = (slot[bad] + 1) & (len(self.keys) - 1)
            found[bad] = self.keys[slot[bad]]
            val[bad] = self.vals[slot[bad]]
            bad = bad[found[bad] != key[bad]]
        return val

    def advance(self, cps: np.ndarray, start: np.ndarray, length: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Run all chunks in lockstep: end states and summed weights."""
        order = np.argsort(-length, kind="stable")
        begin, left, st = start[order], length[order], state[order].astype(np.int64)
        total = np.zeros(len(order), np.int64)
        live = np.searchsorted(-left, -np.arange(int(left[0]) if len(left) else 0), side="left")
        for t, n in enumerate(live.tolist()):
            v = self.look((st[:n] << 21) | cps[begin[:n] + t])
            np.right_shift(v, _BITS, out=st[:n])
            total[:n] += v & (2 * _OFFSET - 1)
        end, count = np.empty_like(st), np.empty_like(total)
        end[order], count[order] = st, total - left * _OFFSET
        return end, count

    def count(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text."""
        out, i, grown = np.zeros(len(texts), np.int64), 0, 0
        state = at = 0  # in the text that is being counted
        while i < len(texts):
            if self.crowded():
                state = self.forget(state)
            before, part = len(self.states), PART if grown <= GROWING else PART // 8
            if at or len(texts[i]) > part:
                n, state = self._counted([texts[i][at : at + part]], state)
                out[i] += n[0]
                at += part
                if at >= len(texts[i]):
                    i, state, at = i + 1, 0, 0
            else:
                j, size = i, 0
                while j < len(texts) and size + len(texts[j]) <= part:
                    size += len(texts[j])
                    j += 1
                out[i:j], _ = self._counted(texts[i:j], 0)
                i = j
            grown = len(self.states) - before
        return out

    def _counted(self, texts: list[str], begin: int) -> tuple[np.ndarray, int]:
        """Tokens of each text from a start state, and the state at the end."""
        if not any(texts):
            return np.zeros(len(texts), np.int64), begin
        cps = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        size = np.fromiter((len(t) for t in texts), np.int64, len(texts))
        off = np.concatenate([[0], np.cumsum(size)])
        # cut every text each CHUNK characters, at the next blank after a non-blank if one is near
        pieces = np.maximum(1, -(-size // CHUNK))
        doc = np.repeat(np.arange(len(texts)), pieces)
        nth = np.arange(len(doc)) - np.repeat(np.concatenate([[0], np.cumsum(pieces)[:-1]]), pieces)
        start = off[doc] + nth * CHUNK
        blank = (cps == 32) | ((cps >= 9) & (cps <= 13)) | (cps == 0x85) | (cps == 0xA0) | (cps >= 0x1680)
        sync = np.zeros(len(cps) + 1, bool)
        sync[1:-1] = (cps[1:] == 32) & ~blank[:-1]
        where = np.flatnonzero(sync)
        near = where[np.minimum(np.searchsorted(where, start), max(0, len(where) - 1))] if len(where) else start - 1
        first = nth == 0
        ok = ~first & (near >= start) & (near < np.minimum(start + CHUNK // 2, off[doc + 1]))
        start = np.where(ok, near, start)
        constant = first | ok  # the state map doesn't depend on the start state
        length = np.append(start[1:], len(cps)) - start
        domain = np.full((len(start), 2), -1, np.int64)  # start states at which a chunk's map is taken
        domain[constant, 0] = np.where(first[constant], begin, 0)
        g = np.flatnonzero(~constant)
        for k, reach in enumerate((16, 64)):
            back = np.minimum(reach, start[g] - off[doc[g]])
            domain[g, k], _ = self.advance(cps, start[g] - back, back, np.zeros(len(g), np.int64))
        domain[domain[:, 1] == domain[:, 0], 1] = -1
        end, weight = np.full_like(domain, -1), np.zeros_like(domain)
        todo = np.nonzero(domain >= 0)
        while True:
            end[todo], weight[todo] = self.advance(cps, start[todo[0]], length[todo[0]], domain[todo])
            slot = composed(domain, end, constant)
            known = slot >= 0
            gaps = np.flatnonzero(~known[1:] & known[:-1]) + 1  # the first of each chain
            if not len(gaps):
                break
            if (domain[gaps] >= 0).all(axis=1).any():
                domain, end, weight = (np.concatenate([x, np.full((len(x), 1), v)], axis=1) for x, v in ((domain, -1), (end, -1), (weight, 0)))
            free = (domain[gaps] < 0).argmax(axis=1)
            domain[gaps, free] = end[gaps - 1, slot[gaps - 1]]
            todo = gaps, free
        rows = np.arange(len(slot))
        scan = np.concatenate([[0], np.cumsum(weight[rows, slot])])
        edge = np.concatenate([[0], np.cumsum(pieces)])
        return scan[edge[1:]] - scan[edge[:-1]], int(end[-1, slot[-1]])


def composed(domain: np.ndarray, end: np.ndarray, constant: np.ndarray) -> np.ndarray:
    """Which entry of each chunk's map applies, -1 where none does, by a parallel prefix scan.

    Entry k of chunk i sends state domain[i, k] to end[i, k]; entry 0 of a
    constant chunk takes any state.  Each chunk has a function from the entries
    of its predecessor to its own; in round d it is composed with the function
    of the 2^d chunks before, so that in the end it starts at the first chunk.
    """
    n, k = domain.shape
    meets = (domain[1:, None, :] == end[:-1, :, None]) & (end[:-1, :, None] >= 0)
    f = np.full((n, k + 1), k)  # entry k: not known
    f[1:, :k] = np.where(meets.any(axis=2), meets.argmax(axis=2), k)
    f[constant] = 0
    d = 1
    while d < n:
        f[d:] = np.take_along_axis(f[d:], f[:-d], axis=1)
        d *= 2
    return np.where(f[:, 0] == k, -1, f[:, 0])


_compiled: dict[int, Transducer] = {}


def compiled(vocabulary: bytes) -> Transducer:
    """One transducer a worker process; what it has compiled stays for later batches, until another operator begins."""
    key = hash(vocabulary)
    if key not in _compiled:
        _compiled[key] = Transducer(vocabulary)
        keeps("tokens", _compiled.clear)
    return _compiled[key]


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = DEFAULT_VOCABULARY, hashed: bool = False) -> DataFrame:
    """(doc_id, n_tokens) for each row, with a text_hash if ``hashed``; see the module's docstring for nulls and empty texts."""
    with open(vocabulary, "rb") as f:
        shipped = df.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary file: it doesn't grow with the data
    rows = only(df, doc_id=id_col, text=text_col)
    id_type = rows.schema["doc_id"].dataType.simpleString()
    also = {"text_hash": "bigint"} if hashed else {}
    if hashed:
        rows = rows.withColumn("text_hash", F.xxhash64("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begins("tokens")
        machine = compiled(shipped.value)
        for batch in batches:
            texts = batch.column("text")
            out = np.zeros(len(texts), np.int64)
            for i, j in slices(texts, SLICE):
                out[i:j] = machine.count(pc.fill_null(texts.slice(i, j - i), "").to_pylist())
            n = pa.array(out, pa.int64(), mask=np.asarray(texts.is_null()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), n, *(batch.column(c) for c in also)], names=["doc_id", "n_tokens", *also])

    return rows.mapInArrow(count, ", ".join([f"doc_id {id_type}, n_tokens bigint", *(f"{c} {t}" for c, t in also.items())]))
