"""Token-ID output (operator 1): ids in a compressed, checksummed binary format.

The ids of all documents form one stream in ascending doc_id order. It is cut into blocks of
``BLOCK`` ids; each block is coded by itself, with a model that starts empty, and carries the
CRC-32 of its ids. The coder is an adaptive context-mixing range coder:

* order 2 and order 1 each predict one id, the last that followed the two ids (the one id)
  before, with a confidence; the shares of the two predictions are their hit rates so far at this
  pair of confidences, so the mixture adapts to the block;
* order 0 gets the rest: the ids that neither predicted, by their counts so far; an id that was not
  counted yet is escaped and sent as 16 bits.

A block is dealt to up to ``LANES`` lanes of ``STEPS`` consecutive ids. The lanes go in lockstep, as
numpy vectors: each has a range coder of its own, all share the model, which learns a step's ids
after the step. A segment is one row of a Parquet file: whole documents of up to ``SEGMENT`` ids (or
one longer document), with the documents' ids and lengths; its blocks are coded one after the other.
Spark writes and commits the files, so a lost executor repeats its tasks; a failed checksum stops
the reader.

Where the tokenizer drops white space (it is probed), a text's ids are those of its words in order,
and each distinct word is tokenized once per Python worker, which remembers up to a million and then
keeps those that came again; else whole texts are tokenized.

Cases: a null or empty text is the end id alone; a text of any length stays one document; null
doc_ids come first; equal doc_ids are ordered by the hash of their text, and equal rows stay rows
of their own; an empty table gives an empty result; only ``doc_id`` and ``text`` are read. Ids
must be below 65,536.
"""

from __future__ import annotations

import functools
import itertools
import json
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ASCII_SPACE, whole_text

STEPS, LANES = 2048, 4096  # ids of a lane, lanes of a block
BLOCK = STEPS * LANES
SEGMENT = BLOCK
_TILE = 64  # steps whose ids are turned together between the order of the stream and that of the lanes
END_ID = 2
_SLOTS = 20  # bits of the table of order 2
_STATES = 128
_MEMORY_OF_RATES = 1 << 16  # outcomes of a state, halved beyond
_SCALE_BITS, _REST_BITS = np.uint64(14), np.uint64(18)
_SCALE, _REST = 1 << 14, 1 << 18  # parts of the mixture and of order 0; their product is at most _BOTTOM
_WORD, _BOTTOM = np.uint64(32), np.uint64(1 << 32)  # bits that settle at once; a range stays above
_MEMORY, _MEMORY_OF_IDS = 1_000_000, 16_000_000  # words that a worker remembers, and their ids
_MARKS = ".,;:!?*$%&#"
_GROUP = 500  # words of letters that are sent together
_SLICE = 24 << 20  # bytes of text that are encoded together
_PIECE = 1 << 17  # words whose ids are put together at once


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class _Rest:
    """Order 0: shares of the ids that no prediction met, in parts of ``_REST``. Ids that were not counted
    yet share the escape. The shares follow the counts at steps that lie ever further apart."""

    def __init__(self, reading: bool):
        self.reading, self.counts, self.fresh, self.next = reading, np.zeros(1 << 16, np.int64), [], 0
        self._share(_REST, np.zeros(0, np.int64), np.zeros(0, np.int64))

    def _share(self, escape: int, seen: np.ndarray, own: np.ndarray) -> None:
        self.edge = np.uint64(_REST - escape)  # the escape is behind all ids
        self.escape = self.edge << np.uint64(32) | np.uint64(escape)
        self.shares = np.full(1 << 16, self.escape)
        self.shares[seen] = (np.cumsum(own) - own) << 32 | own  # (share before the id, share of the id)
        if self.reading:
            unseen = np.flatnonzero(self.counts == 0)[:1]  # stands for all that are escaped
            self.ids = np.repeat(np.append(seen, unseen).astype(np.uint32), np.append(own, np.full(len(unseen), escape)))

    def count(self, ids: np.ndarray, miss: np.ndarray) -> None:
        self.fresh.append((ids, miss))

    def refresh(self, step: int) -> None:
        if step < self.next or not self.fresh:
            return
        self.next = step + 1 + step // 6
        ids, miss = map(np.concatenate, zip(*self.fresh))
        self.counts += np.bincount(ids[miss], minlength=1 << 16)
        self.fresh = []
        seen = np.flatnonzero(self.counts)
        counts = self.counts.take(seen)
        total, distinct = int(counts.sum()), len(seen)
        if not distinct:
            return
        escape = max(1, _REST * distinct // (2 * (total + distinct)))  # at most a quarter
        own = 1 + counts * (_REST - distinct - escape) // total
        self._share(_REST - int(own.sum()), seen, own)


class _Model:
    """Predictions of order 1 and 2 and their shares in parts of ``_SCALE``. One model serves all lanes
    of a block: each step is predicted from the steps before it, and all lanes' ids are learned after it.

    A state is both confidences and whether both predict the same id. An outcome is a state and what
    was right there: neither (0), order 1 only (1), order 2 (2)."""

    # what an outcome does to the confidences of order 1 and 2; a wrong prediction of low confidence is replaced
    _OUTCOMES = np.arange(3 * _STATES)
    _SURE = (_OUTCOMES >> 1 & 7, _OUTCOMES >> 4 & 7)
    _RIGHT = ((_OUTCOMES >= _STATES) & ((_OUTCOMES < 2 * _STATES) | (_OUTCOMES & 1 == 1)), _OUTCOMES >= 2 * _STATES)
    _CHANGE = [np.where(right, sure < 7, -((sure + 1) >> 1)).astype(np.uint32) for sure, right in zip(_SURE, _RIGHT)]
    _REPLACED = [~right & (sure < 2) for sure, right in zip(_SURE, _RIGHT)]

    def __init__(self, lanes: int):
        self.one, self.two = np.zeros(1 << 16, np.uint32), np.zeros(1 << _SLOTS, np.uint32)  # predicted id and confidence (3 bits)
        self.last, self.before = np.zeros(lanes, np.int64), np.zeros(lanes, np.uint32)
        self.outcomes, self.next = np.ones((3, _STATES), np.int64), 0

    def _share(self) -> None:
        total = self.outcomes.sum(axis=0)
        old = total > _MEMORY_OF_RATES
        if old.any():
            self.outcomes[:, old] = (self.outcomes[:, old] + 1) >> 1
            total = self.outcomes.sum(axis=0)
        own2, own1 = (1 + (_SCALE - 32) * self.outcomes[k] // total for k in (2, 1))
        # by outcome; neither keeps at least 30 parts
        self.below = np.concatenate((own2 + own1, own2, 0 * own2)).astype(np.uint64)
        self.own = np.concatenate((_SCALE - own2 - own1, own1, own2)).astype(np.uint64)

    def predict(self, step: int, n: int) -> None:
        """For the first n lanes: the ids of order 2 and 1, and the state."""
        if step >= self.next:
            self.next = step + 1 + min(step // 16, 15)
            self._share()
        self.at1 = self.last[:n]
        last = self.at1.astype(np.uint32)
        slots = (last * np.uint32(0x85EBCA6B) ^ self.before[:n] * np.uint32(0xC2B2AE35)) * np.uint32(0x27D4EB2F)
        self.at2, self.then = (slots >> np.uint32(32 - _SLOTS)).astype(np.int64), last
        self.found1, self.found2 = self.one.take(self.at1), self.two.take(self.at2)
        self.id1, self.id2 = self.found1 >> np.uint32(3), self.found2 >> np.uint32(3)
        self.state = (self.found2 & np.uint32(7)) << np.uint32(4) | (self.found1 & np.uint32(7)) << np.uint32(1) | (self.id1 == self.id2)

    def outcome(self, right: np.ndarray) -> np.ndarray:
        """``right``: what was right, in bytes."""
        return (self.state + np.uint32(_STATES) * right).astype(np.int64)

    def learn(self, ids: np.ndarray, outcome: np.ndarray) -> None:
        self.outcomes += np.bincount(outcome, minlength=3 * _STATES).reshape(3, _STATES)
        fresh = ids << np.uint32(3) | np.uint32(1)
        for k, table, at, found in ((0, self.one, self.at1, self.found1), (1, self.two, self.at2, self.found2)):
            table[at] = np.where(self._REPLACED[k].take(outcome), fresh, found + self._CHANGE[k].take(outcome))  # of equal places the last lane's stays
        self.before[:len(ids)], self.last[:len(ids)] = self.then, ids


class _Writer:
    """A range coder for each lane, in words of 32 bits. A carry is added to the words that left before.
    The words go out in the order in which :class:`_Reader` asks for them: two of each lane, then the
    next one of a lane whenever its range gets small."""

    def __init__(self, lanes: int, steps: int):
        self.lanes = lanes
        self.low, self.range = np.zeros(lanes, np.uint64), np.full(lanes, 2**64 - 1, np.uint64)
        self.words = np.zeros((2 * steps + 2) * lanes, np.uint32)  # an id settles at most two words; all lanes' first ones, all lanes' second ones...
        self.at, self.settled = np.arange(lanes), []

    def narrow(self, low: np.ndarray, size: np.ndarray, lanes: np.ndarray | None = None) -> None:
        """The intervals of the given lanes (None: of the first ones) are now ``size`` from ``low``."""
        carry = np.flatnonzero(low < (self.low[:len(low)] if lanes is None else self.low.take(lanes)))
        at = self.at.take(carry if lanes is None else lanes.take(carry))
        while len(at):
            at = at - self.lanes
            self.words[at] += np.uint32(1)
            at = at[self.words.take(at) == 0]
        todo = np.flatnonzero(size < _BOTTOM)
        if len(todo):
            who, value = todo if lanes is None else lanes.take(todo), low.take(todo)
            at = self.at.take(who)
            self.words[at] = value >> _WORD
            self.at[who] = at + self.lanes
            self.settled.append(at)
            low[todo], size[todo] = value << _WORD, size.take(todo) << _WORD
        if lanes is None:
            self.low[:len(low)], self.range[:len(low)] = low, size
        else:
            self.low[lanes], self.range[lanes] = low, size

    def finish(self) -> bytes:
        self.words[self.at], self.words[self.at + self.lanes] = self.low >> _WORD, self.low & (_BOTTOM - np.uint64(1))
        ahead = np.concatenate((np.arange(2 * self.lanes), *(at + 2 * self.lanes for at in self.settled)))
        return self.words.take(ahead).astype("<u4").tobytes()


class _Reader:
    """Undoes :class:`_Writer`; ``code`` is what a lane's words say, from the start of its interval."""

    def __init__(self, lanes: int, data: bytes):
        self.words = np.frombuffer(data, "<u4").astype(np.uint64)
        self.next, self.range = 2 * lanes, np.full(lanes, 2**64 - 1, np.uint64)
        self.code = self.words[:lanes] << _WORD | self.words[lanes:2 * lanes]

    def narrow(self, code: np.ndarray, size: np.ndarray, lanes: np.ndarray | None = None) -> None:
        todo = np.flatnonzero(size < _BOTTOM)
        if len(todo):
            code[todo] = code.take(todo) << _WORD | self.words[self.next:self.next + len(todo)]
            size[todo] = size.take(todo) << _WORD
            self.next += len(todo)
        if lanes is None:
            self.code[:len(code)], self.range[:len(code)] = code, size
        else:
            self.code[lanes], self.range[lanes] = code, size


def _shape(n_ids: int) -> tuple[int, int]:
    """Lanes of a block, and the ids of the last one; the others hold ``STEPS``."""
    lanes = -(-n_ids // STEPS)
    return lanes, n_ids - (lanes - 1) * STEPS


def _encode(ids: np.ndarray) -> bytes:
    lanes, short = _shape(len(ids))
    stream = np.zeros((lanes, STEPS), np.uint32)
    stream.reshape(-1)[:len(ids)] = ids
    steps = min(STEPS, len(ids))
    model, rest, coder = _Model(lanes), _Rest(reading=False), _Writer(lanes, steps)
    for t in range(steps):
        n = lanes if t < short else lanes - 1
        if t % _TILE == 0:
            tile = stream[:, t:t + _TILE].T.copy()
        x = tile[t % _TILE, :n]
        rest.refresh(t)
        model.predict(t, n)
        right = np.maximum((model.id2 == x).view(np.uint8) << np.uint8(1), (model.id1 == x).view(np.uint8))
        outcome, miss = model.outcome(right), right == 0
        part = coder.range[:n] >> _SCALE_BITS
        low, size = coder.low[:n] + part * model.below.take(outcome), part * model.own.take(outcome)
        # all lanes are put to order 0; only those that missed go by it
        share, part = rest.shares.take(x), size >> _REST_BITS
        low = np.where(miss, low + part * (share >> _WORD), low)
        size = np.where(miss, part * (share & (_BOTTOM - np.uint64(1))), size)
        coder.narrow(low, size)
        e = np.flatnonzero(miss & (share == rest.escape))
        if len(e):
            part = coder.range.take(e) >> np.uint64(16)
            coder.narrow(coder.low.take(e) + part * x.take(e), part, e)
        rest.count(x, miss)
        model.learn(x, outcome)
    return coder.finish()


def _decode(data: bytes, n_ids: int) -> np.ndarray:
    lanes, short = _shape(n_ids)
    steps = min(STEPS, n_ids)
    stream, tile = np.zeros((lanes, STEPS), np.uint32), np.zeros((_TILE, lanes), np.uint32)
    model, rest, coder = _Model(lanes), _Rest(reading=True), _Reader(lanes, data)
    for t in range(steps):
        n = lanes if t < short else lanes - 1
        rest.refresh(t)
        model.predict(t, n)
        part, code = coder.range[:n] >> _SCALE_BITS, coder.code[:n]
        below = model.below.take(model.state + np.uint32(_STATES))  # what order 2 has
        hit2, miss = code < part * below, code >= part * model.below.take(model.state)
        right = np.where(hit2, np.uint8(2), ~miss)
        outcome = model.outcome(right)
        code, size = code - part * model.below.take(outcome), part * model.own.take(outcome)
        part = size >> _REST_BITS
        value = np.minimum(code // part, np.uint64(_REST - 1))
        x = rest.ids.take(value.view(np.int64), mode="clip")
        share = rest.shares.take(x)
        e = np.flatnonzero(miss & (value >= rest.edge))
        x = np.where(miss, x, np.where(hit2, model.id2, model.id1))
        code = np.where(miss, code - part * (share >> _WORD), code)
        size = np.where(miss, part * (share & (_BOTTOM - np.uint64(1))), size)
        coder.narrow(code, size)
        if len(e):
            part, code = coder.range.take(e) >> np.uint64(16), coder.code.take(e)
            raw = np.minimum(code // part, np.uint64(0xFFFF))
            coder.narrow(code - part * raw, part, e)
            x[e] = raw
        rest.count(x, miss)
        model.learn(x, outcome)
        tile[t % _TILE, :n] = x
        if t % _TILE == _TILE - 1 or t == steps - 1:
            start = t - t % _TILE
            stream[:, start:t + 1] = tile[:t + 1 - start].T
    return stream.reshape(-1)[:n_ids]


def encode_blocks(ids: np.ndarray) -> list[bytes]:
    """The blocks of a stream of ids, each coded by itself."""
    if len(ids) and int(ids.max()) >> 16:
        raise ValueError("ids must be below 65,536")
    return [_encode(ids[i:i + BLOCK]) for i in range(0, len(ids), BLOCK)]


def decode_blocks(blocks: list[bytes], n_ids: int) -> np.ndarray:
    """The stream of ids of :func:`encode_blocks`."""
    parts = [_decode(data, min(BLOCK, n_ids - i * BLOCK)) for i, data in enumerate(blocks)]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint32)


class _Numbers(defaultdict):
    """Numbers words in the order in which they are first met; the fresh ones are those whose ids are not known yet."""

    def __init__(self, known: list[bytes] = ()):
        super().__init__(itertools.count(len(known)).__next__, zip(known, range(len(known))))
        self.known = len(known)

    def take_fresh(self) -> tuple[int, list[bytes]]:
        """The first number of the fresh words, and these."""
        start, self.known = self.known, len(self)
        return start, list(itertools.islice(reversed(self), len(self) - start))[::-1]


# the steps of the tokenizer file that :meth:`_Words._shortened` knows
_NORMAL_FORM = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_STRETCHES = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}


def _is_latin(text: str) -> bool:
    try:
        text.encode("latin-1")
        return True
    except UnicodeEncodeError:
        return False


class _Words:
    """The ids of words: each distinct word is tokenized once and numbered; a text is its words' numbers."""

    _LETTERS = ("a", "word", "Ab", "é", "你", "s")
    _PROBES = ("a", "word", "Ab's", "don", "'t", "12", "é", "\u0301x", ".", "<|", "你")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # the ids that close a piece, where the tokenizer marks them
        mark, vocabulary = getattr(self.tokenizer.model, "end_of_word_suffix", None), self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values(), default=0) + 1, bool) if mark else None
        if mark:
            self.closes[[i for token, i in vocabulary.items() if token.endswith(mark)]] = True
        self.tails: dict[str, bool] = {}
        self.short = self._shortened()
        # whether a text's ids are those of its words in order; else whole texts are "words"
        own = {w: self._ids([w])[0] for w in self._PROBES}
        pairs = [(x, y, x + gap + y) for x in self._PROBES for y in self._PROBES for gap in (*ASCII_SPACE, " \t\n")]
        self.splits = all(coded == own[x] + own[y] for (x, y, _), coded in zip(pairs, self._ids([t for _, _, t in pairs])))
        self.clear()

    def clear(self) -> None:
        self.number = _Numbers()
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.first, self.size = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.met = np.zeros(1 << 14, np.int32)  # slices that held the word

    def _shortened(self):
        """The tokenizer without the steps that change nothing in lower-case words of Latin-1 letters
        with spaces between them: such words are in normal form already, and each is a stretch of its own.
        None unless all its steps are known to be of this kind."""
        from tokenizers import Tokenizer, pre_tokenizers

        steps = json.loads(self.tokenizer.to_str())
        apart = all(any(not (c.isalpha() or c.isspace()) for c in t["content"]) for t in steps["added_tokens"])
        if not apart or (steps["normalizer"], steps["pre_tokenizer"], steps["truncation"], steps["padding"]) != (_NORMAL_FORM, _STRETCHES, None, None):
            return None
        short = Tokenizer(self.tokenizer.model)
        short.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        return short

    def _ids(self, texts: list[str], tokenizer=None) -> list[list[int]]:
        return [c.ids for c in (tokenizer or self.tokenizer).encode_batch_fast(texts, add_special_tokens=False)]

    def _ids_of_letters(self, texts: list[str]) -> list[list[int]]:
        """The ids of texts that hold nothing but letters and single spaces."""
        latin = [self.short is not None and _is_latin(t) for t in texts]
        short = iter(self._ids([t.lower() for t, x in zip(texts, latin) if x], self.short))
        whole = iter(self._ids([t for t, x in zip(texts, latin) if not x]))
        return [next(short if x else whole) for x in latin]

    def _plain_tail(self, tail: str) -> bool:
        """Whether these marks are one closed piece of their own behind letters."""
        if tail not in self.tails:
            own, *pairs = self._ids([tail, *(w + tail for w in self._LETTERS), *self._LETTERS])
            n = len(self._LETTERS)
            self.tails[tail] = int(self.closes[own].sum()) == 1 and all(pairs[k] == pairs[n + k] + own for k in range(n))
        return self.tails[tail]

    def _learn(self) -> None:
        """Tokenize the fresh words. Words of letters are sent together and told apart by the tokens that
        close a piece: each closes one at least, so as many closed pieces as words show that each
        closed its own. Plain marks behind letters are put to the letters' ids. The others are sent
        one by one."""
        start, fresh = self.number.take_fresh()
        if not fresh:
            return
        together = self.closes is not None and self.splits  # no word holds a space
        marked, parts, alone = [], [], []

        def decoded(words):
            return b" ".join(words).decode("utf-8", "replace").split(" ") if together else [w.decode("utf-8", "replace") for w in words]

        texts = decoded(fresh)
        letters = np.fromiter(map(str.isalpha, texts), bool, len(texts)) & together
        for k in np.flatnonzero(~letters).tolist():
            text = texts[k]
            stem = text.rstrip(_MARKS) if together else ""
            if stem.isalpha() and self._plain_tail(tail := text[len(stem):]):
                marked.append(start + k)
                parts += (self.number[stem.encode()], self.number[tail.encode()])
            else:
                alone.append(k)
        _, fresh = self.number.take_fresh()  # stems and tails
        if fresh:
            more = decoded(fresh)
            alpha = np.fromiter(map(str.isalpha, more), bool, len(more))
            alone += (len(texts) + np.flatnonzero(~alpha)).tolist()
            texts, letters = texts + more, np.append(letters, alpha)
        some = np.flatnonzero(letters)
        words = [texts[k] for k in some.tolist()]
        coded = self._ids_of_letters([" ".join(words[i:i + _GROUP]) for i in range(0, len(words), _GROUP)])
        for i, ids in zip(range(0, len(words), _GROUP), coded):
            ids, numbers = np.array(ids, np.uint32), some[i:i + _GROUP]
            ends = np.flatnonzero(self.closes.take(ids)) + 1
            if len(ends) == len(numbers) and ends[-1] == len(ids):
                self._add(start + numbers, ids, np.diff(ends, prepend=0))
            else:
                alone += numbers.tolist()
        for i in range(0, len(alone), 10_000):
            numbers = np.array(alone[i:i + 10_000])
            coded = self._ids([texts[k] for k in numbers.tolist()])
            self._add(start + numbers, np.array([x for ids in coded for x in ids], np.uint32), np.array([len(ids) for ids in coded]))
        if marked:
            two = np.array(parts)
            self._add(np.array(marked), self._gather(two), self.size.take(two).reshape(-1, 2).sum(axis=1))

    def _forget(self) -> None:
        """Keep the words that were met in several slices since the last time, if they are few; else none."""
        kept = np.flatnonzero(self.met[:len(self.number)] > 1)
        ids, sizes = self._gather(kept), self.size.take(kept)
        words = list(itertools.compress(self.number, self.met > 1))
        self.clear()
        if len(kept) <= _MEMORY // 2 and len(ids) <= _MEMORY_OF_IDS // 2:
            self.number = _Numbers(words)
            self._add(np.arange(len(kept)), ids, sizes)
            self.met[:len(kept)] = 1

    def _gather(self, numbers: np.ndarray) -> np.ndarray:
        """The ids of words, one after the other."""
        sizes = self.size.take(numbers)
        after = np.cumsum(sizes)
        at = np.arange(after[-1] if len(after) else 0) + np.repeat(self.first.take(numbers) - (after - sizes), sizes)
        return self.flat.take(at)

    def _add(self, numbers: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        used = self.used
        while len(self.number) > len(self.first):
            self.first, self.size, self.met = (np.concatenate((a, np.zeros_like(a))) for a in (self.first, self.size, self.met))
        while used + len(ids) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.first[numbers], self.size[numbers] = used + np.cumsum(sizes) - sizes, sizes
        self.flat[used:used + len(ids)] = ids
        self.used += len(ids)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in order, and how many each has."""
        texts = texts.cast(pa.large_binary()).fill_null(b"").cast(pa.large_string(), safe=False)
        if self.splits:
            lists = pc.ascii_split_whitespace(texts)
            words, ends = lists.values, lists.offsets.to_numpy()
            del lists
        else:
            words, ends = texts, np.arange(len(texts) + 1)
        coded = words.dictionary_encode()
        del texts, words
        known = coded.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False)
        if len(self.number) > _MEMORY or self.used > _MEMORY_OF_IDS:
            self._forget()
        numbers = np.fromiter(map(self.number.__getitem__, known), np.int64, len(known))
        at = coded.indices.to_numpy(zero_copy_only=False)
        del coded, known
        self._learn()
        self.met[numbers] += 1
        after = np.cumsum(self.size.take(numbers).take(at))
        lengths = np.diff(np.concatenate((np.zeros(1, np.int64), after)).take(ends))
        ids = np.empty(int(after[-1]) if len(after) else 0, np.uint32)
        for i in range(0, len(at), _PIECE):
            some = self._gather(numbers.take(at[i:i + _PIECE]))
            end = int(after[min(i + _PIECE, len(at)) - 1])
            ids[end - len(some):end] = some
        return ids, lengths


@functools.lru_cache(maxsize=2)
def _words(path: str) -> _Words:
    return _Words(path)


def _slices(texts: pa.Array):
    """(start, rows) of parts of a column of texts: about ``_SLICE`` bytes, or one longer text."""
    size = np.asarray(pc.fill_null(pc.binary_length(texts), 0), np.int64)
    part = (np.cumsum(size) - size) // _SLICE
    edges = np.flatnonzero(np.diff(part, prepend=-1))
    return zip(edges.tolist(), np.diff(edges, append=len(size)).tolist())


def write(docs: DataFrame, folder: str, path: str, end_id: int = END_ID) -> None:
    """Encode every text and write the ids to ``folder`` in ascending doc_id order."""
    import os

    text = whole_text()
    rows = docs.select("doc_id", F.xxhash64(text).alias("h"), text.cast("binary").alias("text"))
    rows = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").drop("h")

    def run(batches):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        words, part, segment = _words(path), TaskContext.get().partitionId(), 0
        names, coded, size = [], [], 0

        def flush():
            ids = np.concatenate(coded)
            checks = [zlib.crc32(ids[i:i + BLOCK].astype("<u4").tobytes()) for i in range(0, len(ids), BLOCK)]
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([segment], pa.int32()), pa.array([len(ids)], pa.int64()),
                 pa.array([names], pa.list_(kind)), pa.array([[len(c) for c in coded]], pa.list_(pa.int64())),
                 pa.array([checks], pa.list_(pa.int64())), pa.array([encode_blocks(ids)], pa.list_(pa.binary()))],
                ["part", "segment", "n_ids", "doc_ids", "lengths", "checks", "blocks"])

        for b in batches:
            kind = b.schema.field(0).type
            for start, n in _slices(b.column(1)):
                some = b.slice(start, n)
                ids, lengths = words.encode(some.column(1))
                ends = np.cumsum(lengths)
                ids = np.insert(ids, ends, end_id)  # one more id a document
                ends += np.arange(1, n + 1)
                for name, a, z in zip(some.column(0).to_pylist(), (ends - lengths - 1).tolist(), ends.tolist()):
                    if names and size + z - a > SEGMENT:
                        yield flush()
                        names, coded, size, segment = [], [], 0, segment + 1
                    names.append(name)
                    coded.append(ids[a:z])
                    size += z - a
        if names:
            yield flush()

    kind_name = docs.schema["doc_id"].dataType.simpleString()
    schema = (f"part int, segment int, n_ids long, doc_ids array<{kind_name}>, lengths array<long>, "
              "checks array<long>, blocks array<binary>")
    rows.mapInArrow(run, schema).write.parquet(folder)


def _decoded(files: DataFrame, value: str, of_ids) -> DataFrame:
    """Per document: part, segment, inside (ids of the segment before it), n_tokens, doc_id and
    what ``of_ids(ids, offsets)`` makes of its ids."""
    kind = files.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches):
        for b in batches:
            for row in range(b.num_rows):
                s = b.slice(row, 1)
                names, lengths = s.column(3).flatten(), s.column(4).flatten().to_numpy()
                part, segment, n_ids = (s.column(k)[0].as_py() for k in range(3))
                ids = decode_blocks(s.column(6)[0].as_py(), n_ids)
                for k, check in enumerate(s.column(5)[0].as_py()):
                    if zlib.crc32(ids[k * BLOCK:(k + 1) * BLOCK].astype("<u4").tobytes()) != check:
                        raise ValueError(f"part {part}, segment {segment}, block {k}: wrong checksum")
                offsets = np.append(0, np.cumsum(lengths))
                for a in range(0, len(lengths), 2000):
                    z = offsets[a:a + 2001]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([part] * (len(z) - 1), pa.int32()), pa.array([segment] * (len(z) - 1), pa.int32()), names.slice(a, 2000),
                         pa.array(z[:-1]), pa.array(lengths[a:a + 2000]), of_ids(ids[z[0]:z[-1]], z - z[0])],
                        ["part", "segment", "doc_id", "inside", "n_tokens", "value"])

    kind = f"part int, segment int, doc_id {kind}, inside long, n_tokens long, value {value}"
    rows = files.select("part", "segment", "n_ids", "doc_ids", "lengths", "checks", "blocks").mapInArrow(run, kind)
    return rows.join(_starts(files), ["part", "segment"]).withColumn("start", F.col("offset") + F.col("inside"))


def read_back(spark: SparkSession, folder: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens and the ids."""

    def lists(ids, offsets):
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids.astype(np.int32)))

    return _decoded(spark.read.parquet(folder), "array<int>", lists).select("doc_id", "start", "n_tokens", F.col("value").alias("ids"))


def digests(spark: SparkSession, folder: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens and the CRC-32 of the ids as little-endian
    unsigned 32-bit integers. The ids stay in the task that decodes them."""

    def crc(ids, offsets):
        coded = ids.astype("<u4")
        return pa.array([zlib.crc32(coded[a:z]) for a, z in zip(offsets.tolist(), offsets[1:].tolist())], pa.int64())

    return _decoded(spark.read.parquet(folder), "long", crc).select("doc_id", "start", "n_tokens", F.col("value").alias("ids_crc32"))


def _starts(files: DataFrame) -> DataFrame:
    """The ids before each segment: sums by partition first, then inside a partition."""
    sizes = files.select("part", "segment", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("earlier", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)))
    return sizes.join(parts, "part").select("part", "segment", (F.col("ahead") + F.col("earlier")).alias("offset"))


def op1_token_output(spark, sf_dir: str) -> DataFrame:
    from ..session import scratch_path
    from .common import read

    folder = scratch_path(spark, "token-files")
    write(read(spark, sf_dir, "documents"), folder, default_tokenizer())
    return digests(spark, folder)
