"""Workbooks of the XLS format (97-2003): records of a stream in a file of chained sectors."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from datetime import datetime

from auditspark.sources.sheets import EPOCH, EPOCH_1904, cell_text, is_date_format

#: Fixed values of the formats: signatures, ends of chains, record numbers, error codes.
SIGNATURE = bytes.fromhex("D0CF11E0A1B11AE1")
LAST_SECTOR = 0xFFFFFFFA  # this and larger numbers name no sector
BOF, EOF, CONTINUE, SHEET, STRINGS, FORMAT, STYLE, DATES, PASSWORD = 0x0809, 0x000A, 0x003C, 0x0085, 0x00FC, 0x041E, 0x00E0, 0x0022, 0x002F
NUMBER, RK, MULTI_RK, SHARED, LABEL, RICH, BOOLEAN, FORMULA, RESULT = 0x0203, 0x027E, 0x00BD, 0x00FD, 0x0204, 0x00D6, 0x0205, 0x0006, 0x0207
ERRORS = {0: "#NULL!", 7: "#DIV/0!", 15: "#VALUE!", 23: "#REF!", 29: "#NAME?", 36: "#NUM!", 42: "#N/A"}


def stream(content: bytes, names: tuple[str, ...]) -> bytes:
    """The first of the named streams of a compound file. Chains that leave the file or run in circles raise."""
    if content[:8] != SIGNATURE:
        raise ValueError("no compound file")
    shift, small_shift = struct.unpack_from("<HH", content, 0x1E)
    n_tables, first_entry, _, cutoff, small_table, _, more_tables, _ = struct.unpack_from("<I I 4s I I I I I", content, 0x2C)
    size = 1 << shift

    def sector(n: int) -> bytes:
        if (n + 1) << shift >= len(content):
            raise ValueError(f"sector {n} lies outside the file")
        return content[(n + 1) << shift : (n + 2) << shift].ljust(size, b"\0")

    def numbers(data: bytes) -> tuple[int, ...]:
        return struct.unpack(f"<{len(data) // 4}I", data)

    places = list(struct.unpack_from("<109I", content, 0x4C))
    while more_tables < LAST_SECTOR and len(places) <= len(content) // 4:
        *more, more_tables = numbers(sector(more_tables))
        places += more
    follows = numbers(b"".join(sector(p) for p in places[:n_tables] if p < LAST_SECTOR))

    def chain(first: int, after: tuple[int, ...]) -> Iterator[int]:
        for _ in range(len(after) + 1):
            if first >= LAST_SECTOR:
                return
            if first >= len(after):
                raise ValueError(f"sector {first} is not in the table")
            yield first
            first = after[first]
        raise ValueError("sectors in a circle")

    def whole(first: int) -> bytes:
        return b"".join(map(sector, chain(first, follows)))

    entries = whole(first_entry)
    found = {}
    for at in range(0, len(entries) - 127, 128):
        named = struct.unpack_from("<H", entries, at + 64)[0]
        found[entries[at : at + max(0, named - 2)].decode("utf-16-le", "replace").lower()] = struct.unpack_from("<II", entries, at + 116)
    root = struct.unpack_from("<II", entries, 116)
    for name in names:
        if name.lower() not in found:
            continue
        first, length = found[name.lower()]
        if length >= cutoff:
            return whole(first)[:length]
        small, unit = whole(root[0]), 1 << small_shift
        return b"".join(small[n << small_shift : (n << small_shift) + unit] for n in chain(first, numbers(whole(small_table))))[:length]
    raise ValueError(f"no stream {' or '.join(names)}")


def records(data: bytes, at: int = 0) -> Iterator[tuple[int, list[bytes]]]:
    """(number, its parts) of the records from a place on: those that only continue one are its further parts."""
    number, parts = None, []
    while at + 4 <= len(data):
        n, size = struct.unpack_from("<HH", data, at)
        part, at = data[at + 4 : at + 4 + size], at + 4 + size
        if n == CONTINUE and number is not None:
            parts.append(part)
            continue
        if number is not None:
            yield number, parts
        number, parts = n, [part]
    if number is not None:
        yield number, parts


class Parts:
    """Reads on over the ends of a record's parts. Characters that go on in a part say anew how wide they are."""

    def __init__(self, parts: list[bytes], at: int = 0):
        self.parts, self.k, self.at = parts, 0, at

    def take(self, n: int) -> bytes:
        out = b""
        while n > 0:
            piece = self.parts[self.k][self.at : self.at + n]
            out, n, self.at = out + piece, n - len(piece), self.at + len(piece)
            if n > 0:
                self.next_part()
        return out

    def next_part(self) -> None:
        if self.k + 1 == len(self.parts):
            raise ValueError("a record ends within a text")
        self.k, self.at = self.k + 1, 0

    def text(self, n: int | None = None) -> str:
        """A text with its marks; n characters, or as many as it says itself."""
        n = struct.unpack("<H", self.take(2))[0] if n is None else n
        marks = self.take(1)[0]
        runs = struct.unpack("<H", self.take(2))[0] if marks & 8 else 0
        extra = struct.unpack("<I", self.take(4))[0] if marks & 4 else 0
        out, wide = [], marks & 1
        while n:
            if self.at == len(self.parts[self.k]):
                self.next_part()
                wide = self.take(1)[0] & 1
            k = min(n, (len(self.parts[self.k]) - self.at) >> wide)
            if not k:
                raise ValueError("a character is cut in two")
            out.append(self.take(k << wide))
            out[-1] = out[-1] if wide else out[-1].decode("latin-1").encode("utf-16-le")
            n -= k
        self.take(4 * runs + extra)
        return b"".join(out).decode("utf-16-le", "replace")


def short_number(v: int) -> float:
    """A number of four bytes: an integer, or the upper bits of a double; either may be in hundredths."""
    x = float(v >> 2 if v < 1 << 31 else (v >> 2) - (1 << 30)) if v & 2 else struct.unpack("<d", struct.pack("<Q", (v & ~3) << 32))[0]
    return x / 100 if v & 1 else x


class OldWorkbook:
    """Cells of a workbook as text like those of the newer format; formulas by the values stored with them."""

    def __init__(self, content: bytes):
        self.data = stream(content, ("Workbook", "Book"))
        self.sheets, self.shared, self.epoch, formats, styles = {}, [], EPOCH, {}, []
        for number, parts in records(self.data):
            body = parts[0]
            if number == BOF and struct.unpack_from("<H", body)[0] != 0x0600:
                raise ValueError("a workbook older than Excel 97")
            if number == PASSWORD:
                raise ValueError("a workbook under a password")
            if number == SHEET and body[5] == 0:  # others are charts and macros
                self.sheets[Parts(parts, 7).text(body[6])] = struct.unpack_from("<I", body)[0]
            elif number == STRINGS:
                reader = Parts(parts, 8)
                self.shared = [reader.text() for _ in range(struct.unpack_from("<I", body, 4)[0])]
            elif number == FORMAT:
                formats[struct.unpack_from("<H", body)[0]] = Parts(parts, 2).text()
            elif number == STYLE:
                styles.append(struct.unpack_from("<H", body, 2)[0])
            elif number == DATES and body[:1] == b"\1":
                self.epoch = EPOCH_1904
            elif number == EOF:
                break
        self.dated = {i for i, f in enumerate(styles) if is_date_format(f, formats.get(f, ""))}

    def _number(self, value: float, style: int) -> str:
        return cell_text(value, self.epoch if style in self.dated else None)

    def _cells(self, at: int) -> Iterator[tuple[int, int, str]]:
        """(row, column, text), in the sheet's order."""
        waiting, depth = None, 0
        for number, parts in records(self.data, at):
            body = parts[0]
            if number == BOF:
                depth += 1  # a chart in a sheet has records of its own
            elif number == EOF:
                depth -= 1
                if not depth:
                    return
            elif depth > 1:
                continue
            elif number == RESULT and waiting:
                yield *waiting, Parts(parts).text()
                waiting = None
            elif number in (NUMBER, RK, SHARED, LABEL, RICH, BOOLEAN, FORMULA):
                row, column, style = struct.unpack_from("<HHH", body)
                if number == NUMBER:
                    yield row, column, self._number(struct.unpack_from("<d", body, 6)[0], style)
                elif number == RK:
                    yield row, column, self._number(short_number(struct.unpack_from("<I", body, 6)[0]), style)
                elif number == SHARED:
                    yield row, column, self.shared[struct.unpack_from("<I", body, 6)[0]]
                elif number in (LABEL, RICH):
                    yield row, column, Parts(parts, 6).text()
                elif number == BOOLEAN:
                    yield row, column, truth(body[6], body[7])
                elif body[12:14] != b"\xff\xff":
                    yield row, column, self._number(struct.unpack_from("<d", body, 6)[0], style)
                elif body[6] in (1, 2):
                    yield row, column, truth(body[8], body[6] == 2)
                elif body[6] == 0:
                    waiting = row, column
            elif number == MULTI_RK:
                row, column = struct.unpack_from("<HH", body)
                for k in range((len(body) - 6) // 6):
                    style, v = struct.unpack_from("<HI", body, 4 + 6 * k)
                    yield row, column + k, self._number(short_number(v), style)

    def rows(self, sheet: str | None = None) -> Iterator[tuple[int, dict[int, str]]]:
        """(row, cells by column) of a sheet, by default the first; rows are numbered from 1."""
        if sheet is not None and sheet not in self.sheets:
            raise ValueError(f"no sheet {sheet}; there are {', '.join(self.sheets)}")
        held: dict[int, dict[int, str]] = {}  # 65,536 rows at most; blocks of rows may stand in any order
        for row, column, text in self._cells(self.sheets[sheet or next(iter(self.sheets))]):
            held.setdefault(row + 1, {})[column] = text
        yield from sorted(held.items())


def truth(value: int, error: bool) -> str:
    return ERRORS.get(value, f"#{value}") if error else "True" if value else "False"
