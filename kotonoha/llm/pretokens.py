"""Splitting of texts into pre-tokens, and tables of byte-level vocabularies."""

from __future__ import annotations

import base64
import json

import regex

#: What Unicode calls white space, spelled out so that all regex engines agree.
_WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def compiled(pattern: str) -> regex.Pattern:
    """``pattern`` with ``\\s`` and ``\\S`` spelled out (inside classes as well)."""
    spelled = pattern.replace(r"[^\s", "[^" + _WHITE).replace(r"\s", f"[{_WHITE}]").replace(r"\S", f"[^{_WHITE}]")
    return regex.compile(spelled)


def byte_symbols() -> list[str]:
    """For each byte the printable character that stands for it in byte-level vocabularies: itself if it is printable Latin-1, else the next one from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 of the token's bytes and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(None, map(bytes.strip, f)))}


def read_merges(path: str) -> tuple[list[tuple[str, str]], list[str]]:
    """The merges of a byte-level ``tokenizer.json`` in order of rank, and the added tokens that are cut out of a text first. Files that change texts before merging, or match added tokens otherwise than literally, are an error."""
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    if data.get("normalizer") or any(t.get(k) for t in data.get("added_tokens", []) for k in ("lstrip", "rstrip", "single_word")):
        raise ValueError(f"{path}: normalizers and added tokens with lstrip, rstrip or single_word are not supported")
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in data["model"]["merges"]]
    return merges, [t["content"] for t in data.get("added_tokens", [])]


class Memo(dict):
    """What ``work`` gave for a pre-token; emptied at ``most`` entries and closed to long ones, so that its size is bounded."""

    def __init__(self, work, most: int = 200_000, longest: int = 64):
        super().__init__()
        self.work, self.most, self.longest = work, most, longest

    def __missing__(self, piece: str):
        out = self.work(piece)
        if len(piece) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[piece] = out
        return out
