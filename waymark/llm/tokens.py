"""Token ids of whole texts by a public byte-level BPE vocabulary.

The tokenizers library encodes a text as runs that never cross a word's leading space or line
break, so the ids of a text are those of its words, each with its leading character, in a row.
Words repeat, so a worker asks the library once per distinct word and looks the rest up, from one
task to the next.
This holds unless white space meets white space at a cut; such texts go to the library whole.
"""

from __future__ import annotations

import json
from array import array
from operator import attrgetter

import numpy as np

# A word takes some 200 bytes of its worker.
CACHE_WORDS = 1_500_000
# Words that the library is asked for at a time, and texts whose words are learned together.
ASKED = 20_000
LEARNED = 64
# Letter runs that its model is asked for at a time.
JOINED = 256
# Fixed values of byte-level vocabularies: printable bytes stand for themselves, the others, in
# order, for the characters from 256 on.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_LETTERS = {b: b for b in _PRINTED} | {
    b: 256 + n for n, b in enumerate(b for b in range(256) if b not in _PRINTED)
}
BYTE_SPACE = chr(BYTE_LETTERS[32])
MARKS = ".,;:!?|"
_ID = attrgetter("id")
DEFAULT_VOCABULARY = "byte_bpe_50k.json"


_LETTER_BYTES = {c: b for b, c in BYTE_LETTERS.items()}


def _of_letters(token: str) -> bool:
    """Whether a token with spaces inside may come from runs of letters."""
    try:
        words = bytes(_LETTER_BYTES[ord(c)] for c in token).decode().split()
    except (KeyError, UnicodeDecodeError):
        return True
    return bool(words) and all(w.isalpha() for w in words)


def vocabulary_path(name: str = DEFAULT_VOCABULARY) -> str:
    """A public vocabulary file; resolved where it is called, on each worker."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Encodes lists of texts; keeps about `cache_words` words."""

    def __init__(self, path: str | None = None, cache_words: int = CACHE_WORDS) -> None:
        from tokenizers import Tokenizer

        self._library = Tokenizer.from_file(path or vocabulary_path())
        self._library.encode_special_tokens = True
        self._limit = cache_words
        # A word without its space, or with its line break, and its ids; None: not to be cut here.
        self._known: dict[str, bytes | None] = {}
        self._older: dict[str, bytes | None] = {}
        (self._break,) = self._whole("\n").tolist()
        # Letters are one run, and so is the mark behind them: the library's model can be asked
        # for the run itself if nothing rewrites the text before the cut into runs.
        cut = json.loads(self._library.to_str())
        self._runs = not cut["normalizer"] and (cut["pre_tokenizer"] or {}).get("type") == "ByteLevel"
        self._tokenize = self._library.model.tokenize
        # Where no token of letters holds a space inside, spaced runs can be asked for in one string:
        # what starts with the space starts a run.
        vocabulary = self._library.get_vocab()
        self._joined = self._runs and not any(BYTE_SPACE in t[1:] and _of_letters(t) for t in vocabulary)
        self._leads = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self._leads[[n for t, n in vocabulary.items() if t[:1] == BYTE_SPACE]] = True
        self._marks = {m: self._whole(m).tobytes() for m in MARKS}

    @property
    def vocabulary(self) -> int:
        return self._library.get_vocab_size()

    def _whole(self, text: str) -> np.ndarray:
        (encoded,) = self._library.encode_batch_fast([text], add_special_tokens=False)
        return np.array(encoded.ids, dtype="<u4")

    def _ids(self, words: list[str]) -> list[bytes]:
        """Ids of words without line breaks, encoded as the lines of one text."""
        ids = self._whole("\n" + "\n".join(words))
        cuts = (np.append(np.flatnonzero(ids == self._break), len(ids)) * 4).tolist()
        raw = ids.tobytes()
        return [raw[a + 4 : b] for a, b in zip(cuts, cuts[1:])]

    def _run(self, letters: str) -> bytes:
        """Ids of letters and single spaces, without a cut into runs."""
        as_bytes = letters.replace(" ", BYTE_SPACE) if letters.isascii() else letters.encode().decode("latin-1").translate(BYTE_LETTERS)
        return array("I", map(_ID, self._tokenize(as_bytes))).tobytes()

    def _spaced_runs(self, words: list[str]) -> None:
        """Make runs of letters, each behind a space, known."""
        size = JOINED if self._joined else 1
        for at in range(0, len(words), size):
            part = words[at : at + size]
            raw = self._run(" " + " ".join(part))
            cuts = [0, len(raw)]
            if len(part) > 1:
                cuts[:1] = (np.flatnonzero(self._leads[np.frombuffer(raw, dtype="<u4")]) * 4).tolist()
            self._known.update(zip(part, [raw[a:b] for a, b in zip(cuts, cuts[1:])]))

    def _learn(self, words: set[str]) -> None:
        """Make the words known."""
        spaced, broken, runs, marked = [], [], set(), []
        known, marks = self._known, self._marks
        lead = np.array([self._break], dtype="<u4").tobytes()
        for word in words:
            body = word[1:] if word[:1] == "\n" else word
            mark = body[-1:] if body[-1:] in marks else ""
            letters = body[:-1] if mark else body
            if self._runs and letters.isalpha():
                key = word[:-1] if mark else word
                if key not in known:
                    if body is word:
                        runs.add(key)
                    else:
                        known[key] = lead + self._run(letters)
                if mark:
                    marked.append(word)
            elif not body or body[0].isspace() or body[-1].isspace():
                known[word] = None
            else:
                (spaced if body is word else broken).append(body)
        self._spaced_runs(list(runs))
        known.update([(w, known[w[:-1]] + marks[w[-1]]) for w in marked])
        for at in range(0, len(spaced), ASKED):
            part = spaced[at : at + ASKED]
            self._known.update(zip(part, self._ids([" " + w for w in part])))
        for at in range(0, len(broken), ASKED):
            part = broken[at : at + ASKED]
            self._known.update(("\n" + w, lead + x) for w, x in zip(part, self._ids(part)))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        out = []
        for begin in range(0, len(texts), LEARNED):
            cut = []
            distinct: set[str] = set()
            for text in texts[begin : begin + LEARNED]:
                words = text.replace("\n", " \n").split(" ")
                words[0] = "\n" + words[0]
                distinct.update(words)
                cut.append(words)
            known = self._known
            missing = distinct.difference(known)
            if missing:
                # Words of the last generation that are still in use live on.
                older = self._older
                still = {w: older[w] for w in missing if w in older}
                known.update(still)
                self._learn(missing.difference(still))
            for k, words in enumerate(cut, begin):
                try:
                    out.append(np.frombuffer(b"".join(map(known.__getitem__, words)), dtype="<u4")[1:])
                except TypeError:
                    out.append(self._whole(texts[k]))
            if len(known) > self._limit // 2:
                self._known, self._older = {}, known
        return out


_ENCODERS: dict[str | None, Encoder] = {}


def shared_encoder(path: str | None = None) -> Encoder:
    """This worker's encoder of a vocabulary: one for all its tasks, which keeps the words it knows."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def text_list(column) -> list[str]:
    """A pandas column of texts with null as empty."""
    return ["" if not isinstance(t, str) else t for t in column]
