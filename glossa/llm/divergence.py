"""Source divergence audit: how far the words of each source of a language are from those of the others.

Tasks count the terms of their documents in byte tries, one for each language, whose leaves count by source and hold
the number of documents. A trie is given out leaf by leaf in the order of its bytes and emptied when it is large. The
leaves are range-partitioned by language and term, so that each task merges the tries of one range of prefixes. The
merged leaves are cut into blocks in UTF-8 order; each block walks its leaves with the sums of its language's
sources and gives a partial sum for each pair of sources and the best candidates of each source, ties in the order
of the walk. Sums and last ranks are Spark's.

A count of 0 gives a term the source's base share, so a block adds up pairs in three parts: what all terms have with
base shares, what single counts change, and what two counts in one leaf change. Only the last looks at pairs, those
that meet in a leaf.
"""

from __future__ import annotations

import gc
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import text_or_empty, written

SCALE = 1_000_000_000
#: Bytes of terms: A-Z become a-z, a-z and all bytes from 0x80 on stay, others part terms.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


class Node:
    """A branch of a trie: the bytes that all terms below share, and what follows by the next byte, b"" for a term's end."""

    __slots__ = ("edges", "label")

    def __init__(self, label: bytes, edges: dict[bytes, Node | dict]):
        self.label, self.edges = label, edges


class RadixTrie:
    """Terms by their bytes. A place keeps its leaves in a table until they are many, and branches then.

    A leaf is a list: the documents, then the sources and the counts as lists in step.
    """

    def __init__(self, most: int = 2048):
        self.root: Node | dict = {}
        self.most = most

    def leaf(self, term: bytes) -> list:
        """The leaf of a term, which is made if it's new."""
        node, at, up = self.root, 0, None
        while type(node) is Node:
            label = node.label
            if label and not term.startswith(label, at):
                same = shared(label, term, at)
                node.label = label[same + 1 :]
                node = self.put(up, Node(label[:same], {label[same : same + 1]: node}))
                label = node.label
            at += len(label)
            first = term[at : at + 1]
            up = (node, first)
            at += len(first)
            node = node.edges.get(first)
        if node is None:
            node = self.put(up, {})
        leaf = node.get(term)
        if leaf is None:
            leaf = node[term] = [0, [], []]
            if len(node) > self.most:
                self.put(up, self.branched(node, at))
        return leaf

    def put(self, up: tuple[Node, bytes] | None, node: Node | dict) -> Node | dict:
        if up is None:
            self.root = node
        else:
            up[0].edges[up[1]] = node
        return node

    def branched(self, leaves: dict[bytes, list], at: int) -> Node:
        """A table of leaves, whose terms share ``at`` bytes, as a branch. Its tables may be large, but shrink in turn."""
        least, last = min(leaves), max(leaves)
        end = at + shared(least[at:], last, at)
        edges: dict[bytes, dict] = {}
        for term, leaf in leaves.items():
            edges.setdefault(term[end : end + 1], {})[term] = leaf
        return Node(least[at:end], edges)

    def leaves(self) -> Iterator[tuple[bytes, list]]:
        """Terms with their leaves in the order of their bytes."""
        todo = [self.root]
        while todo:
            node = todo.pop()
            if type(node) is Node:
                todo.extend(node.edges[first] for first in sorted(node.edges, reverse=True))
            else:
                for term in sorted(node):
                    yield term, node[term]


def shared(label: bytes, term: bytes, at: int) -> int:
    """How many bytes of the label stand in the term from ``at`` on."""
    same, end = 0, min(len(label), len(term) - at)
    while same < end and label[same] == term[at + same]:
        same += 1
    return same


def terms_of(text: bytes, piece: int = 1 << 20) -> Iterator[list[bytes]]:
    """The terms of a text in lists, each from about ``piece`` bytes; a term isn't cut."""
    text = text.translate(TERM_BYTES)
    at = 0
    while at < len(text):
        end = text.find(b" ", at + piece)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


class Tally:
    """Terms of documents: by language and source, and documents by language."""

    def __init__(self) -> None:
        self.by: dict[str, dict[str, Counter]] = defaultdict(lambda: defaultdict(Counter))
        self.docs: dict[str, Counter] = defaultdict(Counter)
        self.size = 0

    def add(self, lang: str, source: str, text: bytes) -> None:
        counts, seen = self.by[lang][source], set()
        before = len(counts)
        for words in terms_of(text):
            counts.update(words)
            seen.update(words)
        self.docs[lang].update(seen)
        self.size += len(counts) - before

    def tries(self) -> Iterator[tuple[str, RadixTrie]]:
        for lang in sorted(self.docs):
            trie = RadixTrie()
            leaves = {term: trie.leaf(term) for term in self.docs[lang]}
            for term, docs in self.docs[lang].items():
                leaves[term][0] = docs
            for source, counts in self.by[lang].items():
                for term, n in counts.items():
                    leaf = leaves[term]
                    leaf[1].append(source)
                    leaf[2].append(n)
            yield lang, trie


def lists(values: pa.Array, widths: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(widths)]), pa.int32()), values)


def leaf_batches(tally: Tally, most: int = 10_000) -> Iterator[pa.RecordBatch]:
    """lang, term, docs, sources and counts of a tally's leaves, in UTF-8 order."""
    for lang, trie in tally.tries():
        walk = trie.leaves()
        while part := list(islice(walk, most)):
            terms, leaves = zip(*part)
            docs, sources, counts = zip(*leaves)
            widths = np.fromiter(map(len, sources), np.int64, len(sources))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * len(part), pa.string()),
                    pa.array(terms, pa.binary()),
                    pa.array(docs, pa.int64()),
                    lists(pa.array(list(chain.from_iterable(sources)), pa.string()), widths),
                    lists(pa.array(list(chain.from_iterable(counts)), pa.int64()), widths),
                ],
                names=["lang", "term", "docs", "sources", "counts"],
            )


def counted(docs: DataFrame, lang_col: str, source_col: str, text_col: str, most_counts: int = 1_000_000) -> DataFrame:
    """Leaves of each task's tries: lang, term, docs, sources, counts. Tries of ``most_counts`` counts are given out."""
    rows = docs.select(*[text_or_empty(F.col(c).cast("string")).alias(x) for c, x in ((lang_col, "lang"), (source_col, "source"))], text_or_empty(text_col).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Leaves are many lists without cycles: looking for cycles among them would take as long as making them.
        gc.disable()
        tally = Tally()
        for b in batches:
            for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                tally.add(lang, source, text.as_py())
                if tally.size >= most_counts:
                    yield from leaf_batches(tally)
                    tally = Tally()
        yield from leaf_batches(tally)

    return rows.mapInArrow(run, "lang string, term binary, docs long, sources array<string>, counts array<long>")


def entries_of(sources: pa.Array, counts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray]:
    """Of two list columns in step: each list's length, each entry's source as a number, the names, and the counts."""
    names = sources.flatten().dictionary_encode()
    return sources.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), names.indices.to_numpy(zero_copy_only=False).astype(np.int64), names.dictionary.to_pylist(), counts.flatten().to_numpy(zero_copy_only=False)


def merged(leaves: DataFrame, least_docs: int = 3, block_counts: int = 1_000_000) -> DataFrame:
    """Kept leaves: block, lang, term, total, sources, counts. A block's leaves are one range of a language's order.

    Tasks cut their leaves into pieces of about an eighth of ``block_counts`` counts, and neighbouring pieces make a block, so
    that there are as many blocks as there are leaves for, in however many partitions they were merged.
    """
    ranged = leaves.repartitionByRange("lang", "term").sortWithinPartitions("lang", "term")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first, seen = TaskContext.get().partitionId() << 40, 0
        held: pa.Table | None = None
        for b in chain(batches, [None]):
            # The last leaf of a batch may go on in the next.
            more = [held] if held is not None else []
            table = pa.concat_tables([*more, pa.Table.from_batches([b])] if b is not None else more).combine_chunks() if more or b is not None else None
            if table is None or not table.num_rows:
                continue
            lang, term = table["lang"], table["term"]
            new = pc.or_(pc.not_equal(lang[1:], lang[:-1]), pc.not_equal(term[1:], term[:-1])).to_numpy() if table.num_rows > 1 else np.zeros(0, bool)
            starts = np.concatenate([[0], np.flatnonzero(new) + 1])
            if b is not None:
                held = table.slice(starts[-1])
                table, starts = table.slice(0, starts[-1]), starts[:-1]
            if not len(starts):
                continue
            table = table.combine_chunks()
            docs = np.add.reduceat(table["docs"].to_numpy(), starts)
            widths, src, names, counts = entries_of(table["sources"].combine_chunks(), table["counts"].combine_chunks())
            leaf = np.repeat(np.searchsorted(starts, np.arange(table.num_rows), "right") - 1, widths)
            cells, at = np.unique(leaf * len(names) + src, return_inverse=True)
            sums = np.zeros(len(cells), np.int64)
            np.add.at(sums, at, counts)
            whose = cells // max(1, len(names))
            stay = docs >= least_docs
            entry = stay[whose]
            totals = np.zeros(len(starts), np.int64)
            np.add.at(totals, whose, sums)
            firsts = table.select(["lang", "term"]).take(pa.array(starts[stay]))
            lengths = np.bincount(whose[entry], minlength=len(starts))[stay]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(first + (seen + np.cumsum(lengths)) // max(1, block_counts // 8)),
                    firsts["lang"].combine_chunks(),
                    firsts["term"].combine_chunks(),
                    pa.array(totals[stay]),
                    lists(pa.array(names, pa.string()).take(pa.array(cells[entry] % max(1, len(names)))), lengths),
                    lists(pa.array(sums[entry]), lengths),
                ],
                names=["piece", "lang", "term", "total", "sources", "counts"],
            )
            seen += int(lengths.sum())

    leaves = written(ranged.mapInArrow(run, "piece long, lang string, term binary, total long, sources array<string>, counts array<long>"), "leaves")
    # One row for each piece: a few for each partition and language.
    pieces = leaves.groupBy("lang", "piece").agg(F.sum(F.size("sources")).alias("n"))
    before = F.sum("n").over(Window.partitionBy("lang").orderBy("piece")) - F.col("n")
    blocks = written(pieces.select("lang", "piece", F.floor(before / block_counts).alias("block")), "pieces")
    return leaves.join(blocks, ["lang", "piece"]).drop("piece")


def share(count: np.ndarray, total: np.ndarray | int, terms: int) -> np.ndarray:
    """1 + floor(SCALE * (count + 1) / (total + terms)) in whole numbers, by long division in steps of 1000."""
    rest, whole = count + 1, np.zeros_like(count)
    below = total + terms
    for _ in range(3):
        rest = rest * 1000
        whole = whole * 1000 + rest // below
        rest = rest % below
    return whole + 1


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


class Block:
    """The leaves of one block and language against the sums of the language's sources.

    leaves: the terms, and arrays of the totals, how many sources each has, and these sources' numbers and counts.
    """

    def __init__(self, sources: list[str], sums: np.ndarray, lang_sum: int, terms: int, leaves: tuple):
        self.sources, self.n, self.terms = sources, sums, terms
        self.leaves, totals, self.width, self.src, self.count = leaves
        self.row = np.repeat(np.arange(len(self.width)), self.width)
        self.p = share(self.count, self.n[self.src], terms)
        self.q = share(totals, lang_sum, terms)

    def pair_sums(self) -> np.ndarray:
        """The sum over the block's leaves of how far source i is from source j, by i and j."""
        base = share(np.zeros_like(self.n), self.n, self.terms)
        both = apart(base[:, None], base[None, :])
        out = both * len(self.leaves)
        at, times = np.unique(np.stack([self.src, self.p]), axis=1, return_counts=True)
        for i in range(0, at.shape[1], 4096):
            s, p, k = at[0, i : i + 4096], at[1, i : i + 4096], times[i : i + 4096, None]
            np.add.at(out, s, (apart(p[:, None], base[None, :]) - both[s]) * k)
            np.add.at(out.T, s, (apart(base[None, :], p[:, None]) - both.T[s]) * k)
        starts = np.concatenate([[0], np.cumsum(self.width)[:-1]]) if len(self.width) else self.width
        for k in np.unique(self.width):
            rows = starts[self.width == k]
            for cut in range(0, len(rows), max(1, 1_000_000 // int(k))):
                places = rows[cut : cut + max(1, 1_000_000 // int(k)), None] + np.arange(k)
                s, p = self.src[places], self.p[places]
                for i in range(int(k)):
                    si, pi = s[:, i : i + 1], p[:, i : i + 1]
                    more = apart(pi, p) - apart(pi, base[s]) - apart(base[si], p) + both[si, s]
                    np.add.at(out, (np.broadcast_to(si, s.shape), s), more)
        return out

    def candidates(self, most: int) -> Iterator[tuple[str, bytes, int]]:
        """Each source's terms whose share is above the language's: the ``most`` farthest, equal ones in UTF-8 order."""
        above = self.p > self.q[self.row]
        row, src = self.row[above], self.src[above]
        value = apart(self.p[above], self.q[row])
        order = np.lexsort((row, -value, src))
        row, src, value = row[order], src[order], value[order]
        place = np.arange(len(src)) - np.searchsorted(src, src)
        for i in np.flatnonzero(place < most):
            yield self.sources[src[i]], self.leaves[int(row[i])].as_py(), int(value[i])


def walked(leaves: DataFrame, groups: DataFrame, most: int) -> DataFrame:
    """lang, source, part, item (binary), value: partial sums of pairs and candidates of blocks.

    The sums of a language's sources stand before each of its blocks, so that no table of all groups is held anywhere.
    """
    heads = leaves.select("block", "lang").distinct().join(groups, "lang").select("block", "lang", F.lit(0).alias("kind"), F.col("source").cast("binary").alias("item"), F.col("n").alias("total"), F.array("lang_n", "terms").alias("counts"), F.lit(None).cast("array<string>").alias("sources"))
    body = leaves.select("block", "lang", F.lit(1).alias("kind"), F.col("term").alias("item"), "total", "counts", "sources")
    ordered = heads.unionByName(body).repartition("lang", "block").sortWithinPartitions("lang", "block", "kind", "item")

    def block_rows(key: tuple, heads: list[pa.RecordBatch], body: list[pa.RecordBatch]) -> pa.RecordBatch:
        head, rows = (pa.Table.from_batches(x).combine_chunks() for x in (heads, body))
        sources = [x.decode() for x in head["item"].to_pylist()]
        lang_sum, terms = head["counts"][0].as_py()
        widths, src, names, counts = entries_of(rows["sources"].combine_chunks(), rows["counts"].combine_chunks())
        place = {s: i for i, s in enumerate(sources)}
        src = np.array([place[s] for s in names], np.int64)[src]
        block = Block(sources, head["total"].to_numpy(), lang_sum, terms, (rows["item"], rows["total"].to_numpy(), widths, src, counts))
        pairs, n = block.pair_sums(), len(sources)
        i, j = np.nonzero(~np.eye(n, dtype=bool))
        items = head["item"].combine_chunks()
        names, terms_, values = zip(*found) if (found := list(block.candidates(most))) else ((), (), ())
        return pa.RecordBatch.from_arrays(
            [
                pa.array([key[1]] * (len(i) + len(names)), pa.string()),
                pa.array([sources[x] for x in i] + list(names), pa.string()),
                pa.array(["pair"] * len(i) + ["term"] * len(names), pa.string()),
                pa.concat_arrays([items.take(pa.array(j)), pa.array(terms_, pa.binary())]),
                pa.concat_arrays([pa.array(pairs[i, j]), pa.array(values, pa.int64())]),
            ],
            names=["lang", "source", "part", "item", "value"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, ([], [])
        for b in batches:
            block, lang, kind = (b.column(i) for i in range(3))
            new = pc.or_(pc.not_equal(block[1:], block[:-1]), pc.or_(pc.not_equal(lang[1:], lang[:-1]), pc.not_equal(kind[1:], kind[:-1]))).to_numpy(zero_copy_only=False) if b.num_rows > 1 else np.zeros(0, bool)
            ends = [*(np.flatnonzero(new) + 1).tolist(), b.num_rows]
            for at, end in zip([0, *ends], ends):
                if end > at:
                    if (block[at].as_py(), lang[at].as_py()) != key:
                        if key:
                            yield block_rows(key, *held)
                        key, held = (block[at].as_py(), lang[at].as_py()), ([], [])
                    held[kind[at].as_py()].append(b.slice(at, end - at))
        if key:
            yield block_rows(key, *held)

    return ordered.mapInArrow(run, "lang string, source string, part string, item binary, value long")


def divergence(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least_docs: int = 3, most_terms: int = 200, block_counts: int = 1_000_000) -> DataFrame:
    """lang, source, part, item, value, rank: how far each source is from the others of its language, and its own terms.

    Terms are runs of ASCII letters and of characters beyond ASCII; only A-Z become lower case. A language keeps the
    terms that ``least_docs`` of its documents have. A share is 1 + floor(10^9 (count + 1) / (sum + terms)) of a source
    or of the whole language, and how far p is from q is floor((p - q)^2 / q). Part ``pair`` sums that over all kept
    terms against each other source; part ``term`` has the ``most_terms`` terms that are farthest above the language.
    Equal values come in the UTF-8 order of the item. Values are exact while a language keeps under 2 * 10^9 terms.

    Null languages, sources and texts count as ''. Rows that repeat count each time, also as documents. A source
    without terms takes part with base shares; a language that keeps no term has pairs of value 0 and no terms, one of a
    single source has no pairs. Long texts are read whole, a piece at a time. An empty table gives an empty result;
    other columns aren't read.
    """
    counts = written(counted(docs, lang_col, source_col, text_col), "counts")  # splitters are drawn from it without counting twice
    leaves = merged(counts, least_docs, block_counts)
    name = lambda c: text_or_empty(F.col(c).cast("string"))
    all_groups = docs.select(name(lang_col).alias("lang"), name(source_col).alias("source")).distinct()
    entries = leaves.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("e"))
    sums = entries.groupBy("lang", F.col("e.sources").alias("source")).agg(F.sum("e.counts").alias("n"))
    langs = leaves.groupBy("lang").agg(F.sum("total").alias("lang_n"), F.count(F.lit(1)).alias("terms"))
    filled = all_groups.join(sums, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = written(filled.select("lang", "source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "lang_n", "terms")]), "groups")

    found = written(walked(leaves, groups, most_terms), "walked")
    bare = groups.where("terms = 0").select("lang", "source")
    none = bare.join(bare.withColumnRenamed("source", "item"), "lang").where("source <> item").select("lang", "source", "item", F.lit(0).cast("long").alias("value"))
    item = F.col("item").cast("string").alias("item")
    pairs = found.where("part = 'pair'").groupBy("lang", "source", item).agg(F.sum("value").alias("value")).unionByName(none)
    terms = found.where("part = 'term'").select("lang", "source", item, "value")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))
    ranked = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", rank.alias("rank"))
    return ranked(pairs, "pair").unionByName(ranked(terms, "term").where(F.col("rank") <= most_terms))
