"""BPE encoding and decoding by prefix sharing.

A text is cut into words by the tokenizer's pattern. The distinct words of a batch, sorted, are a trie in depth-first
order: each word keeps the path it shares with the one before and adds nodes for the rest. A node holds the last token of
the encoding of its prefix, and that is all the state there is: the encoding of a prefix is that of the prefix without
its last token, then that token. So a node's token is found among the tokens that end there, longest first: the one that
may follow the last token where it begins. Two tokens may follow each other if encoding their joined bytes gives just
these two. Each shared prefix is computed once, however many words begin with it.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from .shared import documents, map_columns

#: Fixed value: the pattern of byte-level BPE tokenizers.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words that a worker remembers, and bytes up to which a word is worth remembering.
CACHE_WORDS, CACHE_BYTES = 400_000, 200


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for bytes: printable ones stand for themselves, others from U+0100."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokenizer:
    """A byte-level BPE read from a tokenizer file: encode, decode."""

    def __init__(self, content: str) -> None:
        spec = json.loads(content)
        letter = byte_letters()
        raw = lambda s: bytes(letter[c] for c in s)
        model = spec["model"]
        self.token = {raw(s): i for s, i in model["vocab"].items()}
        self.bytes = {i: b for b, i in self.token.items()}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank = {(self.token[raw(a)], self.token[raw(b)]): (k, self.token[raw(a + b)]) for k, (a, b) in enumerate(merges)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes |= {i: s.encode() for s, i in self.special.items()}
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.words = regex.compile(WORDS)
        self.single = [self.token.get(bytes([b])) for b in range(256)]
        self.longest = max(map(len, self.token))
        #: tokens that can be the result of encoding their own bytes
        self.whole = {b: i for b, i in self.token.items() if len(b) == 1 or self.merge(b) == [i]}
        self.widths = sorted({len(b) for b in self.whole}, reverse=True)
        self.follows: dict[tuple[int, int], bool] = {}
        self.known: dict[str, tuple[str, int, bytes]] = {}

    def merge(self, word: bytes) -> list[int]:
        """BPE of a short word as it is defined: the pair of the lowest rank joins first, the leftmost of equals."""
        ids = [self.single[b] for b in word]
        while len(ids) > 1:
            best = min((self.rank.get(p, (1 << 40, 0))[0], k) for k, p in enumerate(zip(ids[:-1], ids[1:], strict=True)))
            if best[0] == 1 << 40:
                break
            k = best[1]
            ids[k : k + 2] = [self.rank[ids[k], ids[k + 1]][1]]
        return ids

    def may_follow(self, a: int, b: int) -> bool:
        if (a, b) not in self.follows:
            if len(self.follows) > 2_000_000:
                self.follows.clear()
            self.follows[a, b] = self.merge(self.bytes[a] + self.bytes[b]) == [a, b]
        return self.follows[a, b]

    def encode_words(self, words: list[bytes]) -> Iterator[tuple[bytes, list[int]]]:
        """The tokens of distinct words, in sorted order."""
        whole, follow = self.whole.get, self.may_follow
        path: list[int] = []  # the last token of each prefix of the word at hand
        size: list[int] = []
        last = b""
        for word in sorted(words):
            n = len(word)
            most = min(len(last), n)
            same = next((k for k in range(most) if last[k] != word[k]), most)
            del path[same:], size[same:]
            for end in range(same + 1, n + 1):
                for width in range(min(end, self.longest), 0, -1):
                    t = whole(word[end - width : end])
                    if t is not None and (width == end or follow(path[end - width - 1], t)):
                        path.append(t)
                        size.append(width)
                        break
                else:
                    raise ValueError("the vocabulary lacks a byte")
            ids, at = [], n
            while at:
                ids.append(path[at - 1])
                at -= size[at - 1]
            last = word
            yield word, ids[::-1]

    def learn(self, words: set[str]) -> dict[str, tuple[str, int, bytes]]:
        """For each word its ids as text, their number, and its bytes decoded from the ids."""
        known = self.known
        if len(known) > CACHE_WORDS:
            known.clear()
        new = {w.encode(): w for w in words if w not in known}
        extra = {}
        for word, ids in self.encode_words(list(new)):
            made = (",".join(map(str, ids)), len(ids), b"".join([self.bytes[i] for i in ids]))
            (known if len(word) <= CACHE_BYTES else extra)[new[word]] = made
        return extra

    def pieces(self, text: str) -> list[str]:
        """A text's words, and special tokens that stand in it."""
        if self.cut is None or not any(s in text for s in self.special):
            return self.words.findall(text)
        out: list[str] = []
        for k, part in enumerate(self.cut.split(text)):
            out += [part] if k % 2 else self.words.findall(part)
        return out

    def run(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """Of each text: number of tokens, ids joined by commas, decoded text."""
        cut = [self.pieces(t) for t in texts]
        for s, i in self.special.items():
            self.known[s] = (str(i), 1, self.bytes[i])
        words = set().union(*map(set, cut)) if cut else set()
        extra = self.learn(words)
        for s, i in self.special.items():
            self.known[s] = (str(i), 1, self.bytes[i])
        get = self.known.__getitem__ if not extra else lambda w: extra.get(w) or self.known[w]
        out = []
        for ws in cut:
            made = [get(w) for w in ws]
            out.append((sum([m[1] for m in made]), ",".join([m[0] for m in made]), b"".join([m[2] for m in made]).decode("utf-8", "replace")))
        return out

    def encode(self, text: str) -> list[int]:
        ids = self.run([text])[0][1]
        return [int(x) for x in ids.split(",")] if ids else []

    def decode(self, ids: list[int]) -> str:
        return b"".join([self.bytes[i] for i in ids]).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def load(path: str) -> Tokenizer:
    with open(path, encoding="utf-8") as f:
        return Tokenizer(f.read())


def bpe_columns(docs: DataFrame, vocab: str, text_col: str = "text", digests: bool = False, keep: list[str] | None = None) -> DataFrame:
    """Adds n_tokens long, and token_ids (text, joined by commas) and decoded; with digests their SHA-256 instead.

    vocab is the path of a tokenizer file that each worker can read. A null text counts as an empty one: no tokens, empty
    ids and text. Columns of these names in the input are replaced; others pass through, or only those named by keep.
    Texts are cut into words whole, whatever their length; a table without rows gives none.
    """
    names = ["ids_sha256", "decoded_sha256"] if digests else ["token_ids", "decoded"]
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in ("n_tokens", *names)]
    made_columns = StructType().add("n_tokens", "long").add(names[0], "string").add(names[1], "string")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()

    def work():
        tokenizer = load(vocab)

        def run(texts: list[str | None]) -> list:
            texts = [t or "" for t in texts]
            made: list[tuple[int, str, str]] = []
            at, chars = 0, 0
            for k, t in enumerate(texts):
                chars += len(t)
                if chars > 4_000_000 or k + 1 == len(texts):
                    made += [(n, sha(i), sha(d)) if digests else (n, i, d) for n, i, d in tokenizer.run(texts[at : k + 1])]
                    at, chars = k + 1, 0
            return [list(x) for x in zip(*made, strict=True)] if made else [[], [], []]

        return run

    return map_columns(docs, [text_col], keep, made_columns, work)


def default_vocab() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op4_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return bpe_columns(documents(spark, sf_dir), default_vocab(), digests=True, keep=["doc_id"])
