"""Decoding entries in one pass: a batch of byte strings becomes texts, ends and spans.

Each row says how its book writes: charset 1 (Latin, a byte a character), 2 (JIS X 0208) or 3 (with GB 2312), and whether it is an
EPWING disc, as some escapes of older discs have no argument. An entry is read along its tokens once; what is open is a
stack, so subscripts may stand in subscripts and spans in spans.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .entries import ARGUMENTS, MOST, OPTIONAL, SKIPS

LATIN, JIS_CODES, GB_CODES = 1, 2, 3
SPAN = "struct<kind:string,start:int,end:int,page:long,offset:int,value:int>"
RESULT = f"text string, stop string, next long, unknown string, spans array<{SPAN}>, error string"
#: Escapes that open a span, those that close it, and its kind.
OPENS = {0x41: "keyword", 0x42: "reference", 0x43: "candidate", 0x0E: "superscript", 0x12: "emphasis", 0x10: "no_newline", 0xE0: "decoration"}
CLOSES = {0x61: "keyword", 0x62: "reference", 0x63: "candidate", 0x0F: "superscript", 0x13: "emphasis", 0x11: "no_newline", 0xE1: "decoration"}
#: Digits that have subscript forms; other digits, as full-width ones, stay as they are.
LOWERED = str.maketrans("0123456789", "₀₁₂₃₄₅₆₇₈₉")

#: Characters: runs that one call decodes, single ones, and bytes that can't begin any.
WIDE_TOKENS = rb"(?P<jis>(?:[\x21-\x7E][\x21-\x7E])+)|(?P<gb>[\x21-\x7E][\xA1-\xFE])|(?P<own>[\xA1-\xFE][\x21-\x7E])|(?P<stray>[\x00-\x1E])|(?P<other>[\x20-\xFF][\x00-\xFF])|(?P<cut>[\x20-\xFF])"
LATIN_TOKENS = rb"(?P<latin>[\x20-\x7E\xA0-\xFF]+)|(?P<own>[\x00-\xFF][\x00-\xFF])|(?P<cut>[\x00-\xFF])"


class Decoder:
    """The tokens of one kind of book."""

    def __init__(self, charset: int, epwing: bool):
        self.charset, self.epwing = charset, epwing
        self.tokens = re.compile(rb"(?P<escape>\x1F)|" + (LATIN_TOKENS if charset == LATIN else WIDE_TOKENS), re.DOTALL)

    def length(self, data: bytes, at: int) -> int:
        """How many bytes an escape has with its argument."""
        code = data[at + 1]
        if code in OPTIONAL:
            bare = (code in (0x1C, 0x1D) and self.charset == GB_CODES) or (not self.epwing and at + 2 < len(data) and data[at + 2] >= 0x1F)
            return 2 if bare else 4
        if code == 0x14:
            return 4
        if code == 0x42:
            return 2 if at + 2 < len(data) and data[at + 2] else 4
        if code == 0x4B:
            return 10 if data[at + 8 : at + 10] == b"\x1f\x6b" else 8
        return 2 + ARGUMENTS.get(code, 0)

    def characters(self, kind: str, found: bytes) -> str:
        if kind == "jis":
            high = bytes(b | 0x80 for b in found)
            try:
                return high.decode("euc_jp")
            except UnicodeDecodeError:  # a code without a character is one sign, and doesn't shift those after it
                return "".join(high[i : i + 2].decode("euc_jp", "replace")[:1] for i in range(0, len(high), 2))
        if kind == "gb":
            return bytes((found[0] | 0x80, found[1])).decode("gb2312", "replace")
        return found.decode("iso8859-1") if kind == "latin" else ""

    def read(self, data: bytes, stop: int | None = None, heading: bool = False, most: int = MOST, start: int = 0, known: Mapping[str, str] | None = None) -> tuple:
        """text, stop, next, unknown, spans, error of the entry that begins at ``start``.

        stop: the escape and its argument as one number, 0x1F09 << 16 | 1 for example; without it the keyword escape that
        opened the entry ends it. Neither counts before the first character nor in headings, which a line end ends. known: what
        private characters stand for, by name; others are tags, and unknown.
        """
        known = known or {}
        out: list[str] = []
        size, at = 0, start
        printed = narrow = False
        skip = opener = None
        lowered: list[tuple[int, int]] = []
        begun: dict[str, list[tuple[int, int | None]]] = {}
        spans: list[tuple] = []
        unknown: set[str] = set()
        ended = error = None
        while at < len(data) and ended is None:
            token = self.tokens.match(data, at)
            kind = token.lastgroup
            if kind == "cut":  # a character that the bytes' end cuts
                error = None if len(data) - start >= most else f"a character is cut at {at}"
                break
            if kind != "escape":
                printed = True
                at = token.end()
                if skip is None:
                    if kind == "own":
                        name = f"{'h' if narrow or self.charset == LATIN else 'z'}{int.from_bytes(token[0], 'big'):04x}"
                        piece = known.get(name)
                        if piece is None:
                            unknown.add(name)
                            piece = f"<gaiji={name}>"
                    else:
                        piece = self.characters(kind, token[0])
                    out.append(piece)
                    size += len(piece)
                continue
            code = data[at + 1] if at + 1 < len(data) else None
            if code == 0x03:
                ended = "hard"
                break
            step = self.length(data, at) if code is not None else 2
            if at + step > len(data):
                error = None if len(data) - start >= most else f"an escape is cut at {at}"
                break
            argument = data[at + 2 : at + step]
            at += step
            if skip is not None:
                skip = None if code == skip else skip
                continue
            if code in SKIPS:
                skip = SKIPS[code]
            elif code in (0x09, 0x41) and printed and not heading and (0x1F00 | code) << 16 | int.from_bytes(argument, "big") == (stop if stop is not None else opener):
                ended = "soft"
            elif code == 0x6C or (code == 0x4B and step == 10) or (code == 0x0A and heading):
                ended = "soft"
            elif code == 0x0A:
                out.append("\n")
                size += 1
            elif code in (0x04, 0x05):
                narrow = code == 0x04
            elif code == 0x06:
                lowered.append((len(out), size))
            elif code == 0x07 and lowered:
                first, size_then = lowered.pop()
                inner = "".join(out[first:])
                if inner:
                    shown = inner.translate(LOWERED) if inner.isdigit() else f"({inner})"
                    out[first:] = [shown]
                    size = size_then + len(shown)
            elif code == 0x09:
                spans.append(("indent", size, size, None, None, int.from_bytes(argument, "big")))
            elif code in OPENS:
                if code == 0x41 and opener is None:
                    opener = 0x1F41 << 16 | int.from_bytes(argument, "big")
                value = int.from_bytes(argument, "big") if code in (0x41, 0xE0) and argument else None
                if code in (0x42, 0x43):  # of references that open twice the last counts
                    begun[OPENS[code]] = []
                begun.setdefault(OPENS[code], []).append((size, value))
            elif code in CLOSES and begun.get(CLOSES[code]):
                start, value = begun[CLOSES[code]].pop()
                page = offset = None
                if code in (0x62, 0x63):
                    digits = argument.hex()
                    if digits.isdecimal() and int(digits):
                        page, offset = int(digits[:8]), int(digits[8:])
                spans.append((CLOSES[code], start, size, page, offset, value))
        ended = ended or ("none" if at - start >= most or (error is None and at < len(data)) else "hard")
        return "".join(out), ended, at, ",".join(sorted(unknown)), spans, error


def decoded(entries: DataFrame, charset: Column | int = JIS_CODES, epwing: Column | bool = True, stop: Column | None = None, heading: bool = False, most: int = MOST, known: Column | None = None) -> DataFrame:
    """entries' columns without ``bytes``, and text, stop, next, unknown, spans and error.

    bytes: an entry's, from its position on, ``most`` at most. stop: a column with the escape and argument that end entries, as one
    number, null where that isn't known. spans: kind, start and end in the text, page and offset of references and candidates (null
    where they lead nowhere), and value, the argument of keywords, decorations and indents. An entry that breaks off within
    a token has an ``error`` and the text up to there. known: a column with a map from names of private characters to what they stand for.
    """
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    kept = [c for c in entries.columns if c != "bytes"]
    rows = entries.select(F.struct(*kept).alias("row"), "bytes", lit(charset).cast("int").alias("charset"), lit(epwing).cast("boolean").alias("epwing"), (stop if stop is not None else F.lit(None)).cast("long").alias("stop"), (known if known is not None else F.lit(None)).cast("map<string,string>").alias("known"))
    names = [f.split()[0] for f in RESULT.split(", ")]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string()]
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("page", pa.int64()), ("offset", pa.int32()), ("value", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoders: dict[tuple, Decoder] = {}
        for b in batches:
            data, charsets, discs, stops, maps = (b.column(i).to_pylist() for i in range(1, 6))
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                got = []
                for i in range(at, at + part.num_rows):
                    how = (charsets[i] or JIS_CODES, discs[i] is not False)
                    if how not in decoders:
                        decoders[how] = Decoder(*how)
                    got.append(decoders[how].read(data[i] or b"", stops[i], heading, most, known=dict(maps[i] or ())))
                cols = list(zip(*got))
                fields = span.value_type
                flat = [s for x in cols[4] for s in x]
                parts = list(zip(*flat)) if flat else [()] * len(fields)
                ends = [0]
                for x in cols[4]:
                    ends.append(ends[-1] + len(x))
                spans = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(p, f.type) for p, f in zip(parts, fields)], fields=list(fields)))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(cols[:4], kinds)), spans, pa.array(cols[5], pa.string())], names=["row", *names])

    schema = f"row {rows.schema['row'].dataType.simpleString()}, {RESULT}"
    return rows.mapInArrow(run, schema).select("row.*", *names)


CUT = "found array<struct<nth:int,text:string>>, done int, resume long"


def headings_cut(streams: DataFrame, most: int = MOST) -> DataFrame:
    """Headings that stand one after the other, each up to where it ends: streams' columns without ``bytes``, and found, done and resume.

    streams: bytes, charset, epwing, wanted (the numbers of the headings asked for, from 0) and done (the number of the heading at which the
    bytes begin). found: nth and text of the wanted ones. Where bytes break off first, resume is the byte at which heading ``done`` begins, else -1.
    """
    kept = [c for c in streams.columns if c not in ("bytes", "charset", "epwing", "done")]
    rows = streams.select(F.struct(*kept).alias("row"), "bytes", "charset", "epwing", F.col("wanted").cast("array<int>").alias("asked"), F.col("done").cast("int").alias("begun"))
    pairs = pa.list_(pa.struct([("nth", pa.int32()), ("text", pa.string())]))

    def cut(decoder: Decoder, data: bytes, wanted: list[int], n: int) -> tuple[list, int, int]:
        at, out, asked = 0, [], set(wanted)
        while n <= max(wanted, default=-1):
            text, stop, after, *_ = decoder.read(data, heading=True, most=most, start=at)
            if stop != "soft" and at > 0 and len(data) >= most:
                return out, n, at
            if n in asked:
                out.append({"nth": n, "text": text})
            if stop == "hard":  # nothing follows: all others are empty
                return out + [{"nth": k, "text": ""} for k in wanted if k > n], n, -1
            n, at = n + 1, after
        return out, n, -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoders: dict[tuple, Decoder] = {}
        for b in batches:
            got = []
            for data, *how, wanted, n in zip(*(b.column(i).to_pylist() for i in range(1, 6))):
                if tuple(how) not in decoders:
                    decoders[tuple(how)] = Decoder(*how)
                got.append(cut(decoders[tuple(how)], data or b"", wanted or [], n))
            found, done, resume = zip(*got) if got else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pairs), pa.array(done, pa.int32()), pa.array(resume, pa.int64())], names=["row", "found", "done", "resume"])

    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, {CUT}").select("row.*", "found", "done", "resume")


def chains_cut(places: DataFrame, most: int = MOST) -> DataFrame:
    """Entries read one after the other from each place on, as far as the bytes go: places' columns without ``bytes``, and reads and resume.

    places: start, offset, ends (the escape and argument that end entries, as one number), width (of shapes), left (how many entries to read) and
    bytes. reads: start of each entry that ends softly, ``to``, where the next one begins if that escape stands ``offset`` bytes behind its start,
    and the shape there. resume: the place from which bytes are lacking and the number of entries left, null where the chain is at its end.
    """
    kept = [c for c in places.columns if c != "bytes"]
    rows = places.select(F.struct(*kept).alias("row"), "bytes", *[F.col(c).cast("long").alias(f"x_{c}") for c in ("start", "offset", "ends", "width", "left")])
    read_type = pa.list_(pa.struct([("start", pa.int64()), ("to", pa.int64()), ("shape", pa.binary())]))
    rest_type = pa.struct([("start", pa.int64()), ("left", pa.int64())])

    def follow(decoder: Decoder, data: bytes, start: int, offset: int, ends: int, width: int, left: int) -> tuple[list, dict | None]:
        at, out = 0, []
        full = len(data) >= most  # more bytes may follow
        while left > 0 and 0 <= at < len(data):
            _, stop, after, *_ = decoder.read(data, ends, most=most, start=at)
            to = after - 4 - offset
            if full and (stop != "soft" or to + width > len(data)):
                # The entry, or the shape behind it, may go on beyond the bytes; one that began with them is as long as an entry may be.
                return out, {"start": start + at, "left": left} if at > 0 else None
            if stop != "soft":
                break
            out.append({"start": start + at, "to": start + to, "shape": data[to : to + width] if to >= 0 else None})
            left -= 1
            if to <= at:  # back into what was read: another chain's place, or none
                return out, {"start": start + to, "left": left} if left > 0 and start + to >= 0 else None
            at = to
        return out, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(JIS_CODES, True)
        for b in batches:
            got = [follow(decoder, data or b"", *rest) for data, *rest in zip(*(b.column(i).to_pylist() for i in range(1, 7)))]
            reads, rest = zip(*got) if got else ((), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(reads, read_type), pa.array(rest, rest_type)], names=["row", "reads", "resume"])

    schema = f"row {rows.schema['row'].dataType.simpleString()}, reads array<struct<start:long,to:long,shape:binary>>, resume struct<start:long,left:long>"
    return rows.mapInArrow(run, schema).select("row.*", "reads", "resume")


def spans_of(texts: DataFrame, kind: str) -> DataFrame:
    """A row for each span of a kind, in the order in which they end: texts' columns without spans, nth, start, end, page, offset, value, label (its text)."""
    kept = [c for c in texts.columns if c not in ("spans", "error", "unknown", "next", "stop")]
    each = texts.select(*kept, F.posexplode(F.filter("spans", lambda s: s["kind"] == kind)).alias("nth", "s"))
    label = F.expr("substring(text, s.start + 1, s.end - s.start)")
    return each.select(*[c for c in kept if c != "text"], "nth", "s.start", "s.end", "s.page", "s.offset", "s.value", label.alias("label"))
