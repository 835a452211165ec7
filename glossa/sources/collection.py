"""A directory of books as tables: from files to subbooks, indexes, index entries, headwords and entry texts.

Each table is a DataFrame over the one before it, so a query reads what it needs. Whoever asks often writes
``entries`` and ``texts`` as Parquet once and queries those.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.codes import PAGE, be_uint, gaiji_name
from ..functions.normalize import CONVERT, canonical_by, full_width, latin, to_hira, upper_latin
from ..operators import boundary as B
from ..operators import decode as T
from ..operators import entries as E
from ..operators import lookup as K
from ..operators.postings import multi_lists
from ..operators.private_chars import latest, resolved
from ..operators.runs import carried, grouped_entries, running_total
from ..operators.stored import written
from . import discs as D
from . import files as S
from .ranges import disc_pages

CHARSETS = {1: "ISO 8859-1", 2: "JIS X 0208", 3: "JIS X 0208 + GB 2312"}
BLANK = "^[\\s\u3000]*$"


def style_of(indexes: DataFrame) -> DataFrame:
    """indexes with the ``style`` that holds for each, and whether the words of its book are Latin."""
    own = D.applied_style(F.col("index_id"), F.col("flags"), F.col("available"), F.col("overall"), F.col("charset") == T.LATIN)
    return indexes.withColumn("style", own)


def canonical_word(word: Column, style: Column, charset: Column) -> Column:
    """A converted word by an index's style. Of Latin words only the letters and the blanks are changed."""
    bare = F.when(style["space"] == 2, F.translate(word, " ", "")).otherwise(word)
    return F.when(charset == T.LATIN, F.when(style["lower"] == CONVERT, upper_latin(bare)).otherwise(bare)).otherwise(canonical_by(word, style))


def converted(word: Column, charset: Column) -> Column:
    """A word in the characters of a book, null if it can't be written in them."""
    return F.when(charset == T.LATIN, latin(word)).otherwise(full_width(word))


@dataclass
class Collection:
    """Tables of all books under a path.

    subbooks: book, disc, charset, version, subbook, title, directory, index_page, data_file. pages: subbook, page, bytes. indexes: subbook,
    nth, index_id, name, start_page, end_page, flags and what they apply to.
    """

    spark: SparkSession
    subbooks: DataFrame
    pages: DataFrame
    indexes: DataFrame

    def written_as(self) -> DataFrame:
        """subbook, charset and epwing: how each subbook writes. Without a charset it is JIS X 0208."""
        has = self.subbooks.columns
        charset = F.coalesce("charset", F.lit(T.JIS_CODES)) if "charset" in has else F.lit(T.JIS_CODES)
        epwing = F.coalesce(F.col("disc") != "EB", F.lit(True)) if "disc" in has else F.lit(True)
        return self.subbooks.select("subbook", charset.alias("charset"), epwing.alias("epwing"))

    def entries(self, layout: str = "word") -> DataFrame:
        """Index entries: subbook, name, ord, kind, key, group_key, text and heading (locations). keyword and multi have their own layouts."""
        if layout == "multi":
            wanted = self.multi_fields().where("name IS NOT NULL")
        elif layout == "keyword":
            wanted = self.indexes.where(F.col("name").isin("keyword", "cross"))
        else:
            wanted = self.indexes.where(F.col("name").startswith("word_") | F.col("name").startswith("endword_"))
        # An index is a run of pages: it is exploded to meet the pages by equality.
        each = wanted.select("subbook", "name", F.explode(F.sequence("start_page", "end_page")).alias("page"))
        leaves = each.join(self.pages, ["subbook", "page"]).where(be_uint(F.substring("bytes", 1, 1)).bitwiseAND(F.lit(0x80)) > 0)
        found = D.leaf_entries(leaves, layout).withColumn("ord", F.col("page") * PAGE + F.col("slot"))
        loc = lambda p: (F.col(f"{p}_page") - 1) * PAGE + F.col(f"{p}_offset")
        key = F.when(F.col("charset") == T.LATIN, D.latin_text(F.col("key"))).otherwise(D.jis_text(F.col("key")))
        rows = found.join(self.written_as(), "subbook").select("subbook", "name", "ord", "kind", key.alias("key"), loc("text").alias("text"), loc("heading").alias("heading"))
        return grouped_entries(rows, ["subbook", "name"])

    def search(self, words: DataFrame, exact: bool = False, limit: int | None = 30) -> DataFrame:
        """words (query, word, backward) answered in every subbook: query, subbook, text, heading, ord, rank.

        The word's script chooses the index; a subbook without a fitting one, or whose characters can't write the word, has no
        hits. Words are folded by the index's own style. In kana indexes, and among the members of all groups, hiragana and
        katakana are the same. A member of a group is a hit where its group's key fits the folded word and its own key
        fits the word, in kana indexes as it was typed.
        """
        styled = style_of(self.indexes.join(self.written_as(), "subbook")).select("subbook", F.col("name").alias("index_name"), "index_id", "style", "charset")
        asked = []
        for is_latin in (False, True):
            word = latin(F.col("word")) if is_latin else full_width(F.col("word"))
            one = words.select("query", word.alias("word"), "backward").where("word IS NOT NULL")
            names = styled.where(F.col("charset") == T.LATIN if is_latin else F.col("charset") != T.LATIN).select("subbook", F.col("index_name").alias("name")).distinct()
            asked.append(K.selected_index(one, names, "alphabet" if is_latin else None).where("index_name IS NOT NULL"))
        chosen = asked[0].unionByName(asked[1]).join(styled, ["subbook", "index_name"])
        turned = lambda c: F.when(F.col("backward"), F.reverse(c)).otherwise(c)
        folded = turned(canonical_word(F.col("word"), F.col("style"), F.col("charset")))
        typed = F.when(F.col("index_id").isin(0x70, 0x90), turned(F.col("word"))).otherwise(folded)
        kana = F.col("index_name").endswith("_kana")
        as_kana = lambda cond, c: F.when(cond & (F.col("charset") != T.LATIN), to_hira(c)).otherwise(c)
        # A word meets entries by what they are: single ones and headers by the folded word, others by the typed one.
        roles = F.array(
            F.struct(F.lit("plain").alias("role"), as_kana(kana, F.col("typed")).alias("word")),
            F.struct(F.lit("single").alias("role"), as_kana(kana, F.col("folded")).alias("word")),
            F.struct(F.lit("member").alias("role"), as_kana(F.lit(True), F.col("typed")).alias("word")),
        )
        each = chosen.withColumns({"folded": folded, "typed": typed}).withColumn("r", F.explode(roles))
        one = each.select(F.struct("query", as_kana(kana, F.col("folded")).alias("header")).alias("query"), "subbook", F.col("index_name").alias("name"), "r.role", "r.word")
        kinds = F.when(F.col("kind").isin("fixed", "variable"), "plain").otherwise(F.col("kind"))
        keys = self.entries().where("kind <> 'header'").withColumn("role", kinds).join(self.written_as().select("subbook", "charset"), "subbook")
        in_kana = F.col("name").endswith("_kana")
        keys = keys.withColumns({"match": as_kana(in_kana | (F.col("role") == "member"), F.col("key")), "group": as_kana(in_kana, F.col("group_key"))})
        met = K.matched(one, keys, "match", exact, ["subbook", "name", "role"])
        header = F.col("query.header")
        met = met.where((F.col("role") != "member") | ((F.col("group") == header) if exact else F.startswith("group", header)))
        hits = met.select(F.col("query.query").alias("query"), "subbook", "text", F.when(in_kana, F.lit(None)).otherwise(F.col("heading")).alias("own"), "heading", "ord")
        # Kana indexes know a hit by its text alone.
        first = hits.groupBy("query", "subbook", "text", "own").agg(F.min(F.struct("ord", "heading")).alias("x")).select("query", "subbook", "text", "x.heading", "x.ord")
        return K.limited(first, ["query", "subbook"], limit) if limit is not None else first

    def keyword_search(self, words: DataFrame, index: str = "keyword", limit: int | None = 30) -> DataFrame:
        """Entries whose text uses all words of a query: query, subbook, text, ord, rank. words: query, nth, word.

        In each subbook hits stand in the order of its rarest word's list, the first typed one's among equals. Blank words aren't
        asked, and a query of blanks has no hits. A subbook that lacks one of the words has no hits, nor has one whose
        characters can't write one.
        """
        styled = style_of(self.indexes.where(F.col("name") == index).join(self.written_as(), "subbook")).select("subbook", "style", "charset")
        filled = words.where(~F.coalesce(F.col("word").rlike(BLANK), F.lit(True)))
        each = filled.join(styled).withColumn("keyword", canonical_word(converted(F.col("word"), F.col("charset")), F.col("style"), F.col("charset")))
        need = each.groupBy("query", "subbook").agg(F.countDistinct(F.coalesce("keyword", F.lit(""))).alias("need"))
        asked = each.where("keyword IS NOT NULL").groupBy("query", "subbook", "keyword").agg(F.min("nth").alias("nth"))
        rows = self.entries("keyword").where((F.col("name") == index) & (F.col("kind") != "header"))
        posts = rows.select("subbook", F.when(F.col("kind") == "member", F.col("group_key")).otherwise(F.col("key")).alias("keyword"), "text", "ord")
        # Counts are taken in each task first; only the lists of asked words go on.
        posts = posts.join(asked.select("subbook", "keyword").distinct(), ["subbook", "keyword"], "left_semi").groupBy("subbook", "keyword", "text").agg(F.min("ord").alias("ord"))
        sizes = posts.groupBy("subbook", "keyword").agg(F.count(F.lit(1)).alias("df"))
        rated = asked.join(sizes, ["subbook", "keyword"])
        met = posts.join(rated, ["subbook", "keyword"]).groupBy("query", "subbook", "text").agg(F.count(F.lit(1)).alias("met"), F.min(F.struct("df", "nth", "ord")).alias("x"))
        found = met.join(need, ["query", "subbook"]).where("met = need").select("query", "subbook", "text", "x.ord")
        return K.limited(found, ["query", "subbook"], limit) if limit is not None else found

    def keyword_headings(self, hits: DataFrame, index: str = "keyword") -> DataFrame:
        """hits (subbook, text, ord) of keyword_search with ``heading_text``: the headings of a group's members are one stream.

        A header gives the place of its first member's heading, and each heading begins where the one before it ends, across pages. Only
        the groups of the hits are read, each as far as its last hit: a round reads up to 64 KiB of each group that still lacks some.
        """
        by = ["subbook", "name"]
        rows = self.entries("keyword").where(F.col("name") == index)
        counted = running_total(rows, by, "ord", F.when(F.col("kind") == "member", 1).otherwise(0), "before")
        placed = carried(counted, by, "ord", F.when(F.col("kind") != "member", F.struct("heading", "before")), "first")
        nth = F.when(F.col("kind") == "member", F.col("before") - F.col("first.before")).otherwise(0)
        shown = hits.select("subbook", "ord").distinct().join(placed.select("subbook", "ord", "first.heading", nth.cast("int").alias("nth")), ["subbook", "ord"])
        shown = written(shown, "shown")
        # A long group is read in rounds, the next from the heading that the last one broke off in.
        left = shown.groupBy("subbook", "heading").agg(F.array_sort(F.collect_set("nth")).alias("wanted")).withColumns({"location": F.col("heading"), "done": F.lit(0)})
        found: DataFrame | None = None
        while True:
            read = self.bytes_at(left).select("entry.subbook", "entry.location", "bytes")
            cut = T.headings_cut(left.join(read, ["subbook", "location"]).join(self.written_as(), "subbook"))
            cut = written(cut, "cut")
            texts = cut.select("subbook", "heading", F.explode("found").alias("x")).select("subbook", "heading", "x.nth", F.col("x.text").alias("heading_text"))
            found = texts if found is None else found.unionByName(texts)
            left = cut.where("resume >= 0").select("subbook", "heading", "wanted", (F.col("location") + F.col("resume")).alias("location"), "done")
            if left.isEmpty():
                break
        named = shown.join(found, ["subbook", "heading", "nth"], "left").select("subbook", "ord", "heading_text")
        return hits.join(named, ["subbook", "ord"], "left")

    def multi_tables(self) -> DataFrame:
        """The records of the fields of each subbook's multi searches: subbook, multi_no and the columns of discs.multi_table."""
        number = (F.row_number().over(Window.partitionBy("subbook").orderBy("nth")) - 1).alias("multi_no")
        tables = self.indexes.where("name = 'multi'").select("subbook", number, F.col("start_page").alias("page"))
        return D.multi_table(tables.join(self.pages, ["subbook", "page"]).select("subbook", "multi_no", "bytes"))

    def multi_fields(self) -> DataFrame:
        """The fields of each multi search: subbook, multi_no, field_no, label, and name, start_page, end_page of their index, null where they have none.

        The index's name has the field's two numbers and says whether its kana are compared as one. A field's last index counts.
        """
        each = self.multi_tables()
        index = F.when(F.col("is_index") & (F.col("start_page") > 0) & (F.col("end_page") >= F.col("start_page")), F.struct("nth", "index_id", "start_page", "end_page", "flags", "available"))
        fields = each.groupBy("subbook", "multi_no", "field_no", "label").agg(F.max(index).alias("x"))
        kana = F.when(F.col("x.index_id").isin(0xA1, 0xB1), "kana").otherwise("asis")
        name = F.when(F.col("x").isNotNull(), F.concat_ws("/", "multi_no", "field_no", kana))
        return fields.select("subbook", "multi_no", "field_no", "label", name.alias("name"), "x.index_id", "x.start_page", "x.end_page", "x.flags", "x.available")

    def multi_search(self, words: DataFrame, exact: bool = False, limit: int | None = 30) -> DataFrame:
        """Entries that fit all filled fields: query, subbook, text, heading, ord, rank. words: query, multi_no, field_no, word.

        Blank words and a single hyphen aren't asked, and fields that a subbook's search doesn't have aren't either; a field without an index
        has no hits. Words are folded by their field's style. Order and headings are those of the first filled field.
        """
        filled = words.where(~F.coalesce(F.col("word").rlike(BLANK + "|^-$"), F.lit(True)))
        # A field's own flags stand under a table that makes no statement of its own.
        fields = style_of(self.multi_fields().withColumn("overall", F.lit(0)).join(self.written_as(), "subbook"))
        filled = filled.join(fields.select("subbook", "multi_no", "field_no", "name", "style", "charset"), ["multi_no", "field_no"])
        as_kana = lambda name, c: F.when(F.endswith(name, F.lit("/kana")), to_hira(c)).otherwise(c)
        word = canonical_word(converted(F.col("word"), F.col("charset")), F.col("style"), F.col("charset"))
        asked = filled.select(F.struct("query", "subbook").alias("query"), "field_no", "name", as_kana(F.col("name"), word).alias("word"))
        rows = self.entries("multi").where("kind <> 'header'").withColumn("key", F.when(F.col("kind") == "member", F.col("group_key")).otherwise(F.col("key")))
        keys = rows.withColumn("folded", as_kana(F.col("name"), F.col("key")))
        one = asked.where("word IS NOT NULL AND name IS NOT NULL").select(F.struct("query", "field_no").alias("query"), "query.subbook", "name", "word")
        met = K.matched(one, keys, "folded", exact, ["subbook", "name"])
        found = multi_lists(met.select("query.query", "query.field_no", "text", "heading", "ord"), asked)
        found = found.select("query.query", "query.subbook", "text", "heading", "ord")
        return K.limited(found, ["query", "subbook"], limit) if limit is not None else found

    def stop_codes(self, sample: int = 1200, trials: int = 60, depth: int = 25) -> DataFrame:
        """The escape that ends each subbook's entries, found by reading: subbook, code, argument, offset, score.

        Candidates are escapes that stand around the starts of most of ``sample`` entries of the headword indexes; each is followed
        from ``trials`` entries on for ``depth`` entries, and the first before the start among the best is taken. Subbooks
        with fewer than 8 starts have no row. Pages are written once, and each step joins its few places to them.
        """
        index = self.entries().where("kind <> 'header'").select("subbook", "name", "ord", F.col("text").alias("start"))
        starts = written(B.sampled_starts(index, sample), "starts")
        starts = starts.join(starts.groupBy("subbook").agg(F.count(F.lit(1)).alias("n")).where("n >= 8"), "subbook", "left_semi")
        pages = written(self.pages.join(starts.select("subbook").distinct(), "subbook", "left_semi"), "pages")
        before = starts.where("start >= 4").select("subbook", (F.col("start") - 4).alias("location"))
        around = self.bytes_at(before, 128, pages).select("entry.subbook", (F.col("entry.location") + 4).alias("start"), "bytes")
        around = written(starts.join(around, ["subbook", "start"], "left"), "around")
        found = written(B.candidates(B.prologue(around)), "candidates")
        width = found.where("offset >= 0").groupBy("subbook").agg((F.max("offset") + 4).alias("width"))
        shapes = around.join(width, "subbook").select("subbook", "start", F.substring("bytes", F.lit(5), F.col("width")).alias("shape"))
        shapes = B.signatures(shapes).where(F.hex("shape").rlike("^(1F......)+$"))

        def fetch(places: DataFrame, most: int) -> DataFrame:
            rows = self.bytes_at(places.select("subbook", F.col("start").alias("location")), most, pages)
            return rows.select("entry.subbook", F.col("entry.location").alias("start"), "bytes")

        return B.chosen(B.scored(B.followed(found, B.spread(starts, trials), starts, written(shapes, "shapes"), fetch, depth)))

    def own_texts(self, name: str, stop: tuple[int, int] | None = None) -> DataFrame:
        """The text at the start of an index that is itself a text: ``copyright``, ``menu``, ``text``. Columns as texts()."""
        return self.texts(self.starts_of(self.indexes.where(F.col("name") == name)), stop=stop)

    @staticmethod
    def starts_of(indexes: DataFrame) -> DataFrame:
        """Where the texts of indexes begin: at the second byte of their first page, which resyncs after the escape before it."""
        return indexes.select("subbook", ((F.col("start_page") - 1) * PAGE + 1).alias("location"))

    def menu(self) -> DataFrame:
        """The first lines of each subbook's menu; see lines()."""
        return self.lines(self.starts_of(self.indexes.where("name = 'menu'")))

    def lines(self, places: DataFrame) -> DataFrame:
        """The menu lines of texts: subbook, location (of the text), nth, label, start, end, and target (a location), null where a line leads nowhere."""
        found = T.spans_of(self.texts(places), "candidate")
        target = (F.col("page") - 1) * PAGE + F.col("offset")
        return found.select("subbook", "location", "nth", "label", "start", "end", target.alias("target"))

    def menu_tree(self, starts: DataFrame | None = None, most_levels: int | None = None) -> DataFrame:
        """All menu lines that can be reached: level and the columns of lines(). starts: subbook, location; without it each subbook's menu.

        Each level reads the bytes of the texts that the level before leads to and that no level has read, so menus may lead in circles.
        """
        at = written((self.starts_of(self.indexes.where("name = 'menu'")) if starts is None else starts).select("subbook", "location").distinct(), "menus")
        seen, out, level = at, None, 0
        while True:
            level += 1
            rows = written(self.lines(at).withColumn("level", F.lit(level)), "lines")
            out = rows if out is None else out.unionByName(rows)
            at = rows.where("target IS NOT NULL").select("subbook", F.col("target").alias("location")).distinct().join(seen, ["subbook", "location"], "left_anti")
            at = written(at, "menus")
            if level == most_levels or at.isEmpty():
                return out
            seen = seen.unionByName(at)

    def multi_values(self, most_levels: int | None = None) -> DataFrame:
        """The values that the fields of multi searches offer: multi_no, field_no and the columns of menu_tree(), level by level."""
        tables = self.multi_tables()
        menus = tables.where("index_id = 1 AND start_page > 0").groupBy("subbook", "multi_no", "field_no").agg(F.max(F.struct("nth", "start_page")).alias("x")).select("subbook", "multi_no", "field_no", "x.start_page")
        tops = menus.select("subbook", "multi_no", "field_no", ((F.col("start_page") - 1) * PAGE + 1).alias("location"))
        tops = written(tops, "values")
        tree = written(self.menu_tree(tops, most_levels), "values")
        # A field's lines are those of its menu and of what is below it.
        at, out, level = tops, None, 0
        while True:
            level += 1
            rows = written(at.join(tree.where(F.col("level") >= level).drop("level"), ["subbook", "location"]).withColumn("level", F.lit(level)), "field-lines")
            out = rows if out is None else out.unionByName(rows)
            seen = out.select("subbook", "multi_no", "field_no", "location").distinct()
            at = rows.where("target IS NOT NULL").select("subbook", "multi_no", "field_no", F.col("target").alias("location")).distinct().join(seen, ["subbook", "multi_no", "field_no", "location"], "left_anti")
            if level == most_levels or at.isEmpty():
                return out

    def info(self) -> DataFrame:
        """One row a subbook: its columns, charset's name, the names of its searches, its multi searches' labels, and its fonts' sizes."""
        multis = self.multi_tables().select("subbook", "multi_no", "field_no", "label").distinct()
        names = self.indexes.where("name IS NOT NULL AND name <> 'multi' AND name NOT LIKE 'font%'").groupBy("subbook").agg(F.array_sort(F.collect_set("name")).alias("names"))
        counts = multis.groupBy("subbook").agg(F.countDistinct("multi_no").alias("multis"))
        labels = multis.groupBy("subbook", "multi_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("field_no", "label"))), lambda x: x["label"]), " / ").alias("line"))
        labels = labels.groupBy("subbook").agg(F.transform(F.array_sort(F.collect_list(F.struct("multi_no", "line"))), lambda x: x["line"]).alias("labels"))
        fonts = self.indexes.where("name LIKE 'font%'").groupBy("subbook").agg(F.array_sort(F.collect_set(F.substring_index("name", "_", -1).cast("int"))).alias("fonts"))
        rows = self.subbooks
        for more in (names, counts, labels, fonts):
            rows = rows.join(more, "subbook", "left")
        searches = F.concat(F.coalesce("names", F.array().cast("array<string>")), F.when(F.col("multis") > 0, F.array(F.format_string("multi(%d)", "multis"))).otherwise(F.array().cast("array<string>")))
        charsets = F.create_map(*[F.lit(x) for pair in CHARSETS.items() for x in pair])
        return rows.select(*self.subbooks.columns, charsets[F.col("charset")].alias("charset_name"), F.array_join(searches, ", ").alias("searches"), "labels", "fonts")

    def gaiji_of(self, tables: DataFrame) -> DataFrame:
        """The private characters of each subbook: subbook, name, replacement. tables: title, layer, narrow, code, replacement.

        A table is for the subbooks of exactly its title, one without a title for all; of several the highest layer counts, whatever the title.
        """
        rows = tables.select("title", "layer", gaiji_name(F.col("narrow"), F.col("code")).alias("name"), "replacement")
        met = self.subbooks.select("subbook", F.col("title").alias("own")).join(rows, F.col("title").isNull() | (F.col("title") == F.col("own")))
        return resolved(met, ("subbook", "name")).select("subbook", "name", "replacement")

    def texts(self, places: DataFrame, heading: bool = False, stop: tuple[int, int] | DataFrame | None = None, gaiji: DataFrame | None = None) -> DataFrame:
        """Entries at places (subbook, location): subbook, location, text, stop, next, unknown, spans, error.

        gaiji: tables of private characters, as gaiji_of() takes them. Entries are read for the names they use first, so that each is read again
        with those alone.

        stop: the escape and argument that end entries, or those of each subbook (subbook, code, argument), as stop_codes() gives them.
        Each entry is read as its book writes.
        """
        rows = self.bytes_at(places).select("entry.subbook", "entry.location", "bytes").join(self.written_as(), "subbook")
        number = lambda code, argument: code * 65536 + argument
        if isinstance(stop, DataFrame):
            rows = rows.join(stop.select("subbook", number(F.col("code"), F.col("argument")).alias("ends")), "subbook", "left")
        else:
            rows = rows.withColumn("ends", F.lit(number(*stop) if stop else None).cast("long"))
        read = lambda rows, known=None: T.decoded(rows, F.col("charset"), F.col("epwing"), F.col("ends"), heading, known=known)
        if gaiji is None:
            out = read(rows)
        else:
            rows = written(rows, "entries")
            used = read(rows).select("subbook", "location", F.explode(F.split("unknown", ",")).alias("name")).where("name <> ''")
            named = used.join(self.gaiji_of(gaiji), ["subbook", "name"]).groupBy("subbook", "location").agg(F.map_from_entries(F.collect_list(F.struct("name", "replacement"))).alias("known"))
            out = read(rows.join(named, ["subbook", "location"], "left"), F.col("known"))
        return out.select("subbook", "location", "text", "stop", (F.col("location") + F.col("next")).alias("next"), "unknown", "spans", "error")

    def bytes_at(self, places: DataFrame, most: int = E.MOST, pages: DataFrame | None = None) -> DataFrame:
        """entry (subbook, location) and up to ``most`` bytes from there on, 64 KiB at most: a place meets the pages it needs by equality.

        Bytes end where the file does, or before a page that couldn't be read.
        """
        pages = self.pages if pages is None else pages
        into = (F.col("location") % PAGE).cast("int")
        last = F.ceil((into + most) / PAGE).cast("int") - 1
        asked = places.select("subbook", "location").distinct().withColumn("first", F.floor(F.col("location") / PAGE) + 1)
        each = asked.withColumn("page", F.explode(F.sequence(F.col("first"), F.col("first") + last)))
        met = each.join(pages.select("subbook", "page", "bytes"), ["subbook", "page"]).where("bytes IS NOT NULL")
        held = met.groupBy("subbook", "location", "first").agg(F.array_sort(F.collect_list(F.struct("page", "bytes"))).alias("x"))
        whole = F.aggregate(F.filter("x", lambda v, i: v["page"] == F.col("first") + i), F.unhex(F.lit("")), lambda acc, v: F.concat(acc, v["bytes"]))
        return held.select(F.struct("subbook", "location").alias("entry"), F.substring(whole, into + 1, F.lit(most)).alias("bytes"))


DATA_FILES = ("start", "honmon", "honmon2")


def opened(spark: SparkSession, path: str, range_bytes: int | None = None, mode: str | None = None) -> Collection:
    """The books under a path: directories with a catalog. A book's data file is start (EB) or honmon in its data directory (EPWING).

    Catalogs and language files are read whole, at once, and so are the pages that list indexes; data files by ranges of pages whenever
    a table is asked, see ``ranges``, in the same modes.
    """
    listing = S.listed(spark, path)
    named = listing.select(F.concat("directory", F.lit("/"), "name").alias("path"), "directory", "name", S.plain_name(F.col("name")).alias("plain"))
    small = lambda glob: spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path).select("path", "content")
    heads = small("[cC][aA][tT][aA][lL][oO][gG]*").join(named.where(F.col("plain").isin("catalog", "catalogs")), "path")
    languages = small("[lL][aA][nN][gG][uU][aA][gG][eE]*").join(named.where("plain = 'language'"), "path")
    code = be_uint(F.substring("content", 1, 2))
    languages = languages.groupBy(F.col("directory").alias("book")).agg(F.min(F.when(code.isin(*CHARSETS), code)).cast("int").alias("charset"))
    disc = F.when(F.col("plain") == "catalogs", "EPWING").otherwise("EB")
    heads = heads.select(F.col("directory").alias("book"), disc.alias("disc"), "content").join(languages, "book", "left").withColumn("charset", F.coalesce("charset", F.lit(T.JIS_CODES)))
    heads = heads.withColumn("version", F.when(F.col("disc") == "EPWING", be_uint(F.substring("content", 3, 2))))
    subbooks = D.catalog(heads).drop("error").withColumn("subbook", F.concat_ws("/", "book", "directory"))

    data = named.where(F.col("plain").isin(*DATA_FILES)).withColumn("in_data", F.lower("directory").endswith("/data"))
    data = data.withColumn("home", F.lower(F.when(F.col("in_data"), F.regexp_replace("directory", "/[^/]*$", "")).otherwise(F.col("directory"))))
    packed = F.lower("name").rlike(r"\.ebz\.?(;[0-9]+)?$")
    # A data directory comes before the subbook's own, honmon before honmon2, and a plain file before a compressed one.
    order = F.struct((~F.col("in_data")).alias("a"), F.col("plain"), packed.alias("b"), F.col("name"))
    best = data.groupBy("home").agg(F.min_by("path", order).alias("data_file"))
    # What all else is looked up in is written once: a row for each subbook, and for each of its indexes.
    subbooks = written(subbooks.join(best, F.lower("subbook") == F.col("home"), "left").drop("home"), "subbooks")
    read = disc_pages(spark, path, names=",".join(DATA_FILES), range_bytes=range_bytes, mode=mode)
    pages = read.join(subbooks.where("data_file IS NOT NULL").select(F.col("data_file").alias("path"), "subbook"), "path").select("subbook", "page", "bytes", "error")

    tables = pages.join(subbooks.select("subbook", F.col("index_page").alias("page")), ["subbook", "page"]).select("subbook", "bytes")
    # Of several indexes with one number the last counts, but a subbook may have many multi searches.
    listed = D.index_table(tables).drop("error").withColumn("own", F.when(F.col("name") == "multi", F.col("nth")))
    indexes = written(latest(listed, ["subbook", "index_id", "own"], "nth").drop("own"), "indexes")
    return Collection(spark, subbooks, pages, indexes)
