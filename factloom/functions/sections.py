"""Splitting documents into passages that keep their page and their heading."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import functions as F

TARGET = 1200
_HEADING = re.compile(r"(#{1,6})\s+(\S.*)")
_ENDS = (". ", "! ", "? ", "\n")


def split_text(text: str, target: int = TARGET) -> list[str]:
    """Pieces of at most ``target`` characters: paragraphs packed together, longer ones cut at a sentence's end past 40 %, else anywhere."""
    text = re.sub(r"[ \t]+", " ", text).strip()
    if len(text) <= target:
        return [text] if text else []
    out, held = [], ""
    for block in re.split(r"\n\s*\n", text):
        joined = f"{held}\n\n{block}" if held else block
        if len(held) + len(block) + 2 <= target:
            held = joined
            continue
        out.append(held.strip())
        while len(block) > target:
            end = max(block.rfind(mark, 0, target) for mark in _ENDS)
            end = end + 1 if end > target * 0.4 else target
            out.append(block[:end].strip())
            block = block[end:]
        held = block
    return [x for x in [*out, held.strip()] if x]


def is_markdown(text: str) -> bool:
    """It has two headings or more."""
    return sum(bool(_HEADING.match(line)) for line in text.split("\n")) >= 2


def sections(text: str) -> Iterator[tuple[str, str, str]]:
    """(heading line, path, body) of each section; the path has the headings above it, by a stack."""
    stack: list[tuple[int, str]] = []
    line_of, body = "", []
    for line in text.split("\n"):
        found = _HEADING.match(line)
        if not found:
            body.append(line)
            continue
        yield line_of, " > ".join(h for _, h in stack), "\n".join(body)
        depth = len(found[1])
        while stack and stack[-1][0] >= depth:
            stack.pop()
        stack.append((depth, found[2].strip()))
        line_of, body = line.strip(), []
    yield line_of, " > ".join(h for _, h in stack), "\n".join(body)


def passages(text: str | None, pages: list | None = None, target: int = TARGET) -> Iterator[tuple[int | None, str | None, str]]:
    """(page, heading path, text): by page where there are pages; else by section, each piece under its heading; else by paragraphs."""
    if pages:
        for page in pages:
            for piece in split_text(page["text"] or "", target):
                yield page["page"], None, piece
    elif text and is_markdown(text):
        for line, path, body in sections(text):
            for piece in split_text(body, target):
                yield None, path or None, f"{line}\n\n{piece}" if line else piece
    else:
        for piece in split_text(text or "", target):
            yield None, None, piece


class ChunkText:
    """vault_chunk_text(text, target, pages, most): the passages of one document, the first ``most`` of them (all at 0)."""

    def eval(self, text: str, target: int = TARGET, pages: list = None, most: int = 0) -> Iterator[tuple]:
        for seq, (page, heading, piece) in enumerate(passages(text, pages, target or TARGET)):
            if most and seq >= most:
                return
            yield seq, page, heading, piece


CHUNKS = "seq bigint, page int, heading string, text string"
chunk_text = F.udtf(ChunkText, returnType=CHUNKS)
