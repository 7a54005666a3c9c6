"""Byte-level BPE ids from a public tokenizer file, the same as the ``tokenizers`` library gives.

The file's path is a parameter; it must exist on every executor.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
import public_tokenizers

from .common import per_worker

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
END = 2                   # id appended to every document


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself where printable, else from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(other)}


def token_bytes(path: str = TOKENIZER) -> list[bytes]:
    """The bytes that every id of a byte-level vocabulary stands for; special tokens stand for their own strings."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    letters = byte_letters()
    found = {i: bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
             for token, i in spec["model"]["vocab"].items()}
    found |= {t["id"]: t["content"].encode() for t in spec.get("added_tokens", [])}
    return [found.get(i, b"") for i in range(max(found) + 1)]


def encoder(path: str = TOKENIZER) -> Callable[[str], list[int]]:
    """:func:`load_encoder`, loaded once by each Python worker."""
    return per_worker(f"encoder {path}", lambda: load_encoder(path))


def load_encoder(path: str = TOKENIZER, marks: bool = True) -> Callable[[str], list[int]]:
    """text -> ids, without added special tokens (their own strings in a text get their ids, as in the library;
    without ``marks`` they are plain text).

    Where ids follow the merge order, ``tiktoken`` gives the ids of the same vocabulary several times faster;
    for any other file the library itself runs.
    """
    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab, merges = spec["model"]["vocab"], spec["model"].get("merges", [])
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
    plain = spec.get("pre_tokenizer") or {}
    if not (plain.get("type") == "ByteLevel" and not plain.get("add_prefix_space") and not spec.get("normalizer")
            and len(special) < 2 and all(vocab[a + b] == 256 + i for i, (a, b) in enumerate(pairs))):
        library = Tokenizer.from_file(path)
        library.encode_special_tokens = not marks
        return lambda text: library.encode(text, add_special_tokens=False).ids
    letters = byte_letters()
    ranks = {bytes(letters[c] for c in token): i for token, i in vocab.items() if token not in special}
    encode = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                               special_tokens={}).encode_ordinary
    if not special or not marks:
        return encode
    (mark, mark_id), = special.items()

    def ids(text: str) -> list[int]:
        if mark not in text:
            return encode(text)
        out: list[int] = []
        for i, part in enumerate(text.split(mark)):
            out += [mark_id] * (i > 0) + encode(part)
        return out

    return ids


def pieces_of(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids: whole, or cut so that only the first is shorter."""
    if n <= capacity:
        return [(0, n)]
    head = n % capacity
    return [(0, head)] * (head > 0) + [(at, capacity) for at in range(head, n, capacity)]


def document_ids(encode: Callable[[str], list[int]], text: str | None, end: int = END) -> np.ndarray:
    ids = encode(text or "")
    ids.append(end)
    return np.array(ids, "<u4")
