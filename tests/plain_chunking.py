"""Chunking of one document, line by line, unit by unit: what the operator's columns are held against."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

MARK = "[IMAGE:"


@dataclass(frozen=True)
class Limits:
    longest: int = 4096
    shortest: int = 850
    overlap: int = 0
    code: int = 4
    images: int = 4


@dataclass
class Unit:
    kind: str  # text, code, output, major, slide
    text: str
    code: str | None = None


@dataclass
class Piece:
    """A chunk in the making."""

    text: str
    code: list[str] = field(default_factory=list)

    @property
    def images(self) -> int:
        return self.text.count(MARK)


def units_of(content: str, notebook: bool = False, slides: bool = False) -> list[Unit]:
    """The units of a document, line by line."""
    out: list[Unit] = []
    held: list[str] = []
    fence: list[str] | None = None
    lines = iter(enumerate(all_lines := content.split("\n")))

    def flush() -> None:
        body = "\n".join(held).strip()
        held.clear()
        if body:
            out.append(Unit("text", body))

    for n, line in lines:
        bare = line.strip()
        if fence is not None:
            fence.append(line)
            if bare.startswith("```"):
                out.append(Unit("code", "\n".join(fence), "\n".join(fence[1:-1]).strip() or None))
                fence = None
                used, shown = output_after(all_lines, n + 1) if notebook else (0, "")
                if shown:
                    out.append(Unit("output", shown))
                    for _ in range(used):
                        next(lines, None)
        elif slides and bare == "---":
            flush()
        elif bare.startswith("```"):
            flush()
            fence = [line]
        elif bare.startswith("#") and (level := bare.count("#")) <= 2:
            flush()
            out.append(Unit("slide" if slides and "Slide" in bare and level == 2 else "major", line))
        else:
            held.append(line)
    flush()
    return out


def output_after(lines: list[str], start: int) -> tuple[int, str]:
    """(lines used, text) of a cell's output that begins at or after ``start``."""
    at = start
    while at < len(lines) and not lines[at].strip():
        at += 1
    if at == len(lines):
        return 0, ""
    first = at
    if lines[at].strip().startswith("Output:"):
        at += 1
        while at < len(lines):
            bare = lines[at].strip()
            if bare.startswith(("```", "#")) or bare.startswith("<div") and "alert" in bare.lower() or len(bare) >= 500 and MARK not in bare:
                break
            at += 1
    else:
        while at < len(lines) and MARK in lines[at] and not lines[at].strip().startswith("```"):
            at += 1
    return at - start, "\n".join(lines[first:at]).strip()


def breaks(unit: Unit, held: list[Unit], limits: Limits, notebook: bool, slides: bool) -> bool:
    """Does a new chunk begin before this unit?"""
    if not held:
        return False
    length, code = sum(len(u.text) for u in held), sum(u.kind == "code" for u in held)
    full = length >= limits.shortest
    return (
        length + len(unit.text) > limits.longest
        or notebook and unit.kind == "code" and (code >= limits.code or code >= 2 and full)
        or sum(u.text.count(MARK) for u in held) + unit.text.count(MARK) > limits.images
        or unit.kind == "major" and full
        or slides and unit.kind == "slide"
    )


def gathered(units: list[Unit], limits: Limits, notebook: bool, slides: bool) -> list[Piece]:
    """Chunks of consecutive units; with overlap the last units that fit are said again."""
    out: list[Piece] = []
    held: list[Unit] = []

    def close() -> None:
        out.append(Piece("\n\n".join(u.text for u in held), [u.code for u in held if u.code]))

    for unit in units:
        if breaks(unit, held, limits, notebook, slides):
            close()
            kept: list[Unit] = []
            for u in reversed(held):
                if sum(len(k.text) for k in kept) + len(u.text) > limits.overlap:
                    break
                kept.insert(0, u)
            held = kept
        held.append(unit)
    if held:
        close()
    return out


def split_long(piece: Piece, limits: Limits) -> list[Piece]:
    """A chunk of over one and a half times the limit cut at blank lines; its parts hold no code."""
    if len(piece.text) <= 1.5 * limits.longest:
        return [piece]
    out: list[Piece] = []
    held = ""
    for part in piece.text.split("\n\n"):
        if held and len(held) + 2 + len(part) > limits.longest:
            out.append(Piece(held))
            held = part
        else:
            held = f"{held}\n\n{part}" if held else part
    return [*out, Piece(held)] if held else out


def merged(pieces: list[Piece], limits: Limits) -> list[Piece]:
    """Short chunks joined with the next or else the one before while that stays within the limits, then very short ones regardless."""

    def joined(a: Piece, b: Piece) -> Piece:
        return Piece(f"{a.text}\n\n{b.text}", a.code + b.code)

    def fits(a: Piece, b: Piece, force: bool) -> bool:
        return force or len(a.text) + len(b.text) + 2 <= limits.longest and a.images + b.images <= limits.images and len(a.code) + len(b.code) <= limits.code

    pieces = list(pieces)
    for floor, force in ((limits.shortest, False), (limits.shortest // 2, True)):
        i = 0
        while i < len(pieces) and len(pieces) > 1:
            p = pieces[i]
            if len(p.text) >= floor:
                i += 1
            elif i + 1 < len(pieces) and fits(p, pieces[i + 1], force):
                pieces[i : i + 2] = [joined(p, pieces[i + 1])]
            elif i and fits(pieces[i - 1], p, force):
                # What stood before couldn't be joined with a shorter neighbour, so it can't now.
                pieces[i - 1 : i + 1] = [joined(pieces[i - 1], p)]
                i -= 1
            else:
                i += 1
    return pieces


def enforced(piece: Piece, limits: Limits) -> list[Piece]:
    """A chunk with too many images cut after every so many markers, at the next line end within 200 characters."""
    if piece.images <= limits.images:
        return [piece]
    ends = [m.end() for m in re.finditer(r"\[IMAGE:[^\]]*\]", piece.text)]
    cuts = []
    for n in range(limits.images - 1, len(ends) - 1, limits.images):
        stop = min(ends[n] + 200, ends[n + 1] - len(MARK))
        near = piece.text.find("\n", ends[n], max(stop, ends[n]))
        cuts.append(near if near >= 0 else ends[n])
    parts = [piece.text[a:b].strip() for a, b in zip([0, *cuts], [*cuts, len(piece.text)])]
    return [Piece(p, piece.code if i == 0 else []) for i, p in enumerate(parts) if p]


def tidy(text: str) -> str:
    return re.sub(r"(?m)[ \t]+$", "", re.sub(r"\n{3,}", "\n\n", text)).strip()


def chunked(content: str, notebook: bool = False, slides: bool = False, limits: Limits = Limits()) -> list[Piece]:
    """The chunks of one document."""
    pieces = gathered(units_of(content or "", notebook, slides), limits, notebook, slides)
    pieces = merged([q for p in pieces for q in split_long(p, limits)], limits)
    pieces = merged([q for p in pieces for q in enforced(p, limits)], limits)
    return [replace(p, text=tidy(p.text)) for p in pieces]
