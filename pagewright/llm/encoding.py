"""Token ids of whole texts through public tokenizer files, with a memo of safe units.

A byte-level BPE with the usual word pattern never joins a character that is not white
space with white space after it. So a text may be cut before each run of white space:
every unit (white space, then other characters) has the same ids alone as in its text.
Units recur, so a worker encodes each one once. Unseen units that are letters and then signs go to
the library's model as these two parts; others go to the library together, in strings of
bounded size that are joined by line ends, which are a token of their own. A long unit, as in texts without
white space, is cut further where a letter, a digit and a sign meet, which the pattern always parts; only a run of one
class has no safe boundary and goes to the library whole. Other kinds of tokenizers get whole texts.
"""

from __future__ import annotations

import json
import re
import sys
from array import array
from collections.abc import Iterable, Sequence
from functools import lru_cache
from itertools import filterfalse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pagewright.llm.common import compact, environment

#: White space as the tokenizers' pattern has it (Unicode White_Space). Fixed values.
_SPACE = "\t-\r \x85\xa0  -     　"
_ANY_SPACE = re.compile(f"[{_SPACE}]")
#: A unit that is letters and then signs: the pattern always parts them. Fixed ranges of \\p{L} and ASCII signs.
_STEM = re.compile("([A-Za-zÀ-ÖØ-öø-ɏ]+)([!-/:-@\\[-`{-~]*)")
_UNIT = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")
#: What a worker keeps: so many units and so many bytes of them, none longer than so many characters. Others are encoded again for each batch.
MEMO_UNITS, MEMO_BYTES, MEMO_CHARS = 500_000, 128 << 20, 64
#: A longer unit is cut where the pattern always parts its neighbours, so that the library gets strings of about so many characters.
CUT_CHARS = 1 << 14
#: Fixed ranges: letters (ASCII, Chinese, kana), digits and signs whose class no Unicode version changes; the apostrophe is left out, as it may belong to what follows.
_L, _N, _S = "A-Za-zぁ-ゖァ-ヺ一-龥", "0-9", "!-&(-/:-@\\[-`{-~、-〃「-』！，：；？"
_SAFE_CUT = re.compile(f"(?<=[{_L}])(?=[{_N}{_S}])|(?<=[{_N}])(?=[{_L}{_S}])|(?<=[{_S}])(?=[{_L}{_N}])")
#: Characters that go to the library in one string.
JOIN_CHARS = 1 << 14


class UnitEncoder:
    """Ids of texts as bytes of little-endian unsigned integers of ``width`` bytes."""

    def __init__(self, path: str, memo_units: int = MEMO_UNITS):
        environment()
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        spec = json.loads(self.library.to_str())
        pre = spec.get("pre_tokenizer") or {}
        self.added = tuple(t["content"] for t in spec.get("added_tokens", []))
        self.width = 2 if self.library.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.dtype = np.dtype(f"<u{self.width}")
        line = self.library.encode("\n", add_special_tokens=False).ids
        self.by_units = (
            pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
            and not spec.get("normalizer") and spec["model"]["type"] == "BPE" and not spec["model"].get("ignore_merges") and not spec.get("post_processor")
            and len(line) == 1 and all(not t.get("lstrip") and not t.get("rstrip") and not t.get("single_word") and not t.get("normalized") and not _ANY_SPACE.search(t["content"]) for t in spec.get("added_tokens", []))
        )
        self.line, self.memo_units = line[0] if line else -1, memo_units
        self.line_bytes = np.array([self.line], self.dtype).tobytes()
        self.model = self.library.model
        self.model._resize_cache(0) if hasattr(self.model, "_resize_cache") else None  # the memo stands in for it
        self.parts: dict[str, bytes] = {}
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # byte-level BPE shows these bytes as themselves
        self.shown = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in set(shown))}
        self.memo: dict[str, bytes | None] = {}
        self.odd: dict[str, bytes] = {}
        self.held = 0
        self.code = "H" if self.width == 2 else "I"

    def _plain(self, strings: Sequence[str]) -> list[bytes]:
        out: list[bytes] = []
        held: list[str] = []
        for i, s in enumerate(strings):
            held.append(s)
            if len(held) == 64 or i == len(strings) - 1 or sum(map(len, held)) > 4 * CUT_CHARS:
                out += [np.array(e.ids, self.dtype).tobytes() for e in self.library.encode_batch_fast(held, add_special_tokens=False)]
                held = []
        return out

    def _alone(self, strings: list[str]) -> list[bytes]:
        """Ids of strings without line ends or added tokens, each as if alone."""
        out: list[bytes] = []
        joined, held, chars = [], [], 0
        for s in strings:
            held.append(s)
            chars += len(s) + 1
            if chars >= JOIN_CHARS:
                joined.append(held)
                held, chars = [], 0
        joined += [held] if held else []
        for group in joined:
            ids = np.array(self.library.encode_batch_fast(["\n".join(group)], add_special_tokens=False)[0].ids, self.dtype)
            parts = ids.tobytes()
            cuts = np.flatnonzero(ids == self.line) * self.width
            lows = [0, *(cuts + self.width).tolist()]
            highs = [*cuts.tolist(), len(parts)]
            if len(lows) != len(group):
                out += self._plain(group)
            else:
                out += [parts[a:b] for a, b in zip(lows, highs, strict=True)]
        return out

    def _cut(self, unit: str) -> bytes:
        """Ids of a unit without added tokens; a long one goes to the library in parts."""
        at, parts = 0, []
        while len(unit) - at > CUT_CHARS and (m := _SAFE_CUT.search(unit, at + CUT_CHARS)):
            parts.append(unit[at : m.start()])
            at = m.start()
        parts.append(unit[at:])
        return b"".join(self._plain([x])[0] for x in parts)

    def _keep(self, memo: dict, units: Iterable[str]) -> None:
        """Of units that a memo has just learned, those stay that are short and fit in its bounds."""
        for u in units:
            if len(u) > MEMO_CHARS or len(memo) > self.memo_units or self.held > MEMO_BYTES:
                del memo[u]
            else:
                self.held += 2 * sys.getsizeof(u) + 100

    def _part(self, part: str) -> bytes:
        """Ids of a part that the pattern keeps together."""
        got = self.parts.get(part)
        if got is None:
            if len(part) > MEMO_CHARS:
                return self._plain([part])[0]
            # letters and ASCII signs show as themselves, the blank as its own sign
            word = part.replace(" ", self.shown[32]) if part.isascii() else part.encode().decode("latin-1").translate(self.shown)
            got = array(self.code, [t.id for t in self.model.tokenize(word)]).tobytes()
            if len(self.parts) < self.memo_units:
                self.parts[part] = got
        return got

    def _learn(self, units: set[str]) -> None:
        """Units are keyed without the blank before them; those that start a line keep the line end."""
        safe, strings, special = [], [], []
        for u in units:
            body = u[1:] if u[:1] == "\n" else u
            if not body or _ANY_SPACE.search(body):
                self.memo[u] = None
            elif any(t in body for t in self.added):
                special.append(u)
            elif m := _STEM.fullmatch(body):
                stem, signs = m.groups()
                ids = self._part(stem if u[:1] == "\n" else " " + stem) + (self._part(signs) if signs else b"")
                self.memo[u] = self.line_bytes + ids if u[:1] == "\n" else ids
            elif len(body) > CUT_CHARS:
                self.memo[u] = self.line_bytes + self._cut(body) if u[:1] == "\n" else self._cut(" " + u)
            else:
                safe.append(u)
                strings.append(body if u[:1] == "\n" else " " + u)
        for u, ids in zip(safe, self._alone(strings), strict=True):
            self.memo[u] = self.line_bytes + ids if u[:1] == "\n" else ids
        for u, ids in zip(special, self._plain([u if u[:1] == "\n" else " " + u for u in special]), strict=True):
            self.memo[u] = ids

    def _by_runs(self, text: str) -> bytes:
        """Texts with other white space, or two such characters in a row: cut before each run."""
        units = _UNIT.findall(text)
        new = list(dict.fromkeys(u for u in units if u not in self.odd))
        long = [u for u in new if len(u) > CUT_CHARS and not any(t in u for t in self.added)]
        self.odd.update((u, self._cut(u)) for u in long)
        rest = [u for u in new if u not in self.odd]
        self.odd.update(zip(rest, self._plain(rest), strict=True))
        out = b"".join(map(self.odd.__getitem__, units))
        self._keep(self.odd, new)
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and where each text's ids start (one entry more than texts). Null counts as empty."""
        texts = compact(texts)
        if not self.by_units:
            return self._gather(self._plain(texts.to_pylist()))
        cut = pc.binary_join_element_wise(pa.scalar("\n", pa.large_string()), pc.replace_substring(texts, "\n", " \n"), pa.scalar("", pa.large_string()))
        parts = pc.split_pattern(cut, " ")
        bounds = np.asarray(parts.offsets) - parts.offsets[0].as_py()
        d = parts.flatten().dictionary_encode()
        units, codes = d.dictionary.to_numpy(zero_copy_only=False).tolist(), np.asarray(d.indices)
        unseen = set(filterfalse(self.memo.__contains__, units))
        self._learn(unseen)
        each = [self.memo[u] for u in units]
        self._keep(self.memo, unseen)
        unsafe = np.fromiter((x is None for x in each), bool, len(each))
        flat, starts = self._gather([x or b"" for x in each])
        low, n = starts[:-1][codes], np.diff(starts)[codes]
        full = np.diff(bounds) > 0
        low[bounds[:-1][full]] += 1  # the line end put before each text
        n[bounds[:-1][full]] = np.maximum(n[bounds[:-1][full]] - 1, 0)
        ends = np.concatenate(([0], np.cumsum(n)))
        ids = flat[np.repeat(low - ends[:-1], n) + np.arange(ends[-1])] if ends[-1] else flat[:0]
        cuts = ends[bounds]
        if unsafe.any():
            bad = np.add.reduceat(np.concatenate((unsafe[codes], [False])).astype(np.int64), bounds[:-1]) > 0
            rows = texts.to_pylist()
            whole = [np.frombuffer(self._by_runs(rows[i]), self.dtype) if bad[i] else ids[cuts[i] : cuts[i + 1]] for i in range(len(rows))]
            cuts = np.concatenate(([0], np.cumsum([len(x) for x in whole]))).astype(np.int64)
            ids = np.concatenate(whole) if whole else ids
        return ids, cuts

    def _gather(self, each: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.fromiter(map(len, each), np.int64, len(each)) // self.width
        return np.frombuffer(b"".join(each), self.dtype), np.concatenate(([0], np.cumsum(sizes)))

    def counts(self, texts: pa.Array) -> np.ndarray:
        return np.diff(self.encode(texts)[1])


class PieceCounter:
    """Token counts by a sentencepiece model."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)

    def counts(self, texts: pa.Array) -> np.ndarray:
        return np.array([len(x) for x in self.library.encode([t or "" for t in texts.to_pylist()], num_threads=1)], np.int64)


@lru_cache(maxsize=2)
def encoder(path: str) -> UnitEncoder:
    """One encoder a worker process and file."""
    return UnitEncoder(path)


@lru_cache(maxsize=2)
def counter(path: str) -> UnitEncoder | PieceCounter:
    return PieceCounter(path) if path.endswith(".model") else encoder(path)


def tokenizer_path(name: str) -> str:
    """The place of a public tokenizer file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
