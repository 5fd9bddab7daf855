"""Texts decoded with the wrong character encoding: found and restored."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plexora.session import materialize, small_side

# Names of public character sets.
SINGLE = ("cp1252", "latin-1", "cp1250", "cp1251", "cp1253", "cp1254", "cp1257", "iso8859-2", "iso8859-5", "iso8859-7", "iso8859-15", "koi8-r", "mac-roman", "mac-cyrillic", "cp437", "cp850", "cp852", "cp866")
DOUBLE = ("cp1252", "latin-1", "cp1250", "cp1251", "mac-roman", "cp437")
CROSS = ("cp1252", "latin-1", "cp1250", "cp1251", "iso8859-2", "iso8859-5", "koi8-r", "mac-roman", "mac-cyrillic", "cp437", "cp850", "cp852", "cp866")
MULTI = ("cp932", "euc_jp", "gbk", "big5", "euc_kr")
#: Characters that one wrongly decoded character can become, at most.
LONGEST = 9
#: How many times more distinct texts must have a word than its garbled form
#: where the chain of encodings alone does not tell the two apart.
RATIO = 2
#: Words of single documents that must have a character for them to show it clean.
LONE = 3

# a run is tried from its first letter only: linear also over very long ASCII runs
_WORD = r"(?<![A-Za-z])[A-Za-z]*+[^\x00-\x7F][A-Za-z[^\x00-\x7F]]*+"
_PIECE = _WORD + r"|[A-Za-z]+|[\x00-\x40\x5B-\x60\x7B-\x7F]+"
_REFERENCE = r"&#(?:[0-9]{2,7}|[xX][0-9A-Fa-f]{2,6});"
#: Control characters that no written text has, but wrong decoding leaves.
_CONTROL = r"[\u0080-\u0084\u0086-\u009F]"
_LOST = "�"


def resolved(text: Column) -> Column:
    """``text`` with numeric character references replaced by their characters.
    Markup alone is no case of wrong decoding, but it may hide one."""

    def one(x: Column) -> Column:
        body = F.regexp_extract(x, r"^&#([xX]?)([0-9A-Fa-f]+);$", 2)
        code = F.when(F.lower(F.substring(x, 3, 1)) == "x", F.conv(body, 16, 10)).otherwise(body).cast("long")
        valid = x.rlike("^" + _REFERENCE + "$") & code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        return F.when(valid, F.decode(F.unhex(F.lpad(F.hex(F.when(valid, code).otherwise(63)), 8, "0")), "UTF-32")).otherwise(x)

    parts = F.regexp_extract_all(text, F.lit(_REFERENCE + r"|[^&]+|&"), F.lit(0))
    return F.when(F.contains(text, F.lit("&#")), F.array_join(F.transform(parts, one), "")).otherwise(text)


def _tables() -> dict[str, list[str]]:
    """Per single-byte set the character of each byte; undefined bytes stay the
    control characters that lenient decoders make of them."""
    out = {}
    for name in SINGLE:
        row = []
        for b in range(256):
            try:
                row.append(bytes([b]).decode(name))
            except UnicodeDecodeError:
                row.append(chr(b))
        out[name] = row
    return out


def garbled_forms(word: str, tables: dict[str, list[str]], cross: bool = True) -> Iterator[tuple[str, str]]:
    """``(form, chain)`` of ``word`` under every chain of encodings that changes it.

    Chains: UTF-8 read as a single-byte set, once or twice; UTF-8 or an East
    Asian set read as another one; an East Asian set read as single bytes; and,
    with ``cross``, one single-byte set read as another or as UTF-8 with
    replacement characters.
    """
    raw = word.encode("utf-8", "replace")

    def read(b: bytes, name: str) -> str:
        row = tables[name]
        return "".join([row[x] for x in b])

    for name in SINGLE:
        once = read(raw, name)
        yield once, f"utf-8>{name}"
        if name in DOUBLE:
            again = once.encode("utf-8")
            for second in DOUBLE:
                yield read(again, second), f"utf-8>{name}>utf-8>{second}"
    for name in MULTI:
        yield raw.decode(name, "replace"), f"utf-8>{name}"
        try:
            b = word.encode(name)
        except UnicodeEncodeError:
            continue
        for other in ("cp1252", "latin-1", "cp1251", "mac-roman"):
            yield read(b, other), f"{name}>{other}"
        if cross:
            yield b.decode("utf-8", "replace"), f"{name}>utf-8"
    if cross:
        for name in CROSS:
            try:
                b = word.encode(name)
            except UnicodeEncodeError:
                continue
            yield b.decode("utf-8", "replace"), f"{name}>utf-8"
            for other in CROSS:
                if other != name:
                    yield read(b, other), f"{name}>{other}"


def _variants(form: str) -> set[str]:
    """A form, and what is left of it where invisible characters were dropped."""
    return {form, form.replace("\xad", ""), form.rstrip("\xa0"), form.strip("\xa0").replace("\xad", "")}


def _form_rows(cross: bool, least: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Every form of a word once, with all chains that give it."""
    names = ["form", "word", "chains", "docs"]

    def make(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables = _tables()
        for p in parts:
            out, size = [], 0
            for word, docs in zip(p["word"], p["docs"]):
                forms: dict[str, list[str]] = {}
                for form, chain in garbled_forms(word, tables, cross):
                    for v in _variants(form) if cross else (form,):
                        if len(v) >= least and v != word:
                            forms.setdefault(v, []).append(chain)
                for v, chains in forms.items():
                    out.append((v, word, chains, docs))
                    size += len(v) + len(word) + 100 + 20 * len(chains)
                if size > 4_000_000:  # words may be whole sentences
                    yield pd.DataFrame(out, columns=names)
                    out, size = [], 0
            yield pd.DataFrame(out, columns=names)

    return make


_FORMS = "form string, word string, chains array<string>, docs long"


def corpus_words(df: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """``(words of documents, distinct words)``: ``(id_, text_, word)`` once a
    document with a hash of its text, and ``(word, docs, copies)``: the distinct
    texts and the documents that have the word. However often a text is
    delivered, it counts once in ``docs``. A word is a run of letters with a
    non-ASCII character in it; null and ASCII texts have none."""
    at = df.select(F.col(key).cast("long").alias("id_"), resolved(F.col(text)).alias("t_"))
    words = at.select("id_", F.xxhash64("t_").alias("text_"), F.explode(F.array_distinct(F.regexp_extract_all("t_", F.lit(_WORD), F.lit(0)))).alias("word"))
    words = materialize(words, "words")
    per = words.groupBy("word", "text_").agg(F.count(F.lit(1)).alias("n_"))
    return words, materialize(per.groupBy("word").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_").alias("copies")), "vocabulary")


def _damaged(form: str) -> Column:
    """The form has a character that only wrong decoding leaves."""
    return F.col(form).rlike(_CONTROL) | F.contains(form, F.lit(_LOST))


def word_fixes(words: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``(form, word, chain, docs, firm, sure)``: corpus words that are a garbled
    form of another corpus word, by every chain that gives the form.

    Every distinct word without control and replacement characters is a possible
    original. UTF-8 read as something else, and forms with such characters, tell
    by themselves which of the two is the original. Between two single-byte sets
    the original is the word of at least :data:`RATIO` times as many distinct
    texts; where texts tell neither that nor the reverse, documents with copies
    decide, unless the supposed original stands only in texts that are garbled
    themselves. These are ``firm``; others with nearly as many texts are kept as
    candidates for texts that other words show to be garbled. ``sure`` needs no
    second word. A word that is a firm form itself is no original.
    """
    clean = vocabulary.where(~_damaged("word"))
    # a few hundred forms a word: spread the words before making them, by a number
    # of partitions, as adaptive execution would put so few bytes into one task
    tasks = max(vocabulary.sparkSession.sparkContext.defaultParallelism, min(20_000, -(-vocabulary.count() // 5_000)))
    forms = clean.select("word", "docs").repartition(tasks, "word").mapInPandas(_form_rows(True, 1), _FORMS)
    marks = forms.where((F.length("form") > 1) | F.col("form").rlike(_CONTROL))
    hits = marks.join(vocabulary.select(F.col("word").alias("form"), F.col("docs").alias("n_form"), F.col("copies").alias("copies_form")), "form")
    hits = hits.withColumn("chain", F.explode("chains")).withColumn("plain", F.startswith("chain", F.lit("utf-8>")) | _damaged("form"))
    hits = hits.where(F.col("plain") | (F.col("docs") * RATIO >= F.col("n_form"))).drop("chains")
    hits = materialize(hits.join(vocabulary.select("word", "copies"), "word"), "hits")
    told = F.col("plain") | (F.col("docs") >= RATIO * F.col("n_form"))
    tied = hits.where(~told & (F.col("docs") >= F.col("n_form")) & (F.col("copies") >= RATIO * F.col("copies_form")))
    # texts with two firm forms of a chain are garbled: they vouch for no original
    bad = words.join(small_side(hits.where(told).select(F.col("form").alias("word"), "chain").distinct()), "word").select("text_", "chain", "word").distinct()
    bad = bad.groupBy("text_", "chain").agg(F.count(F.lit(1)).alias("n_")).where("n_ >= 2").select("text_").distinct()
    spots = words.join(small_side(tied.select("word").distinct()), "word").select("word", "text_").distinct()
    vouched = spots.join(bad, "text_", "left_anti").select("word").distinct()
    tied = tied.join(vouched, "word", "left_semi").select("form", "word", "chain", F.lit(True).alias("vouched_"))
    hits = hits.join(tied, ["form", "word", "chain"], "left").withColumn("firm", told | F.col("vouched_").isNotNull())
    hits = materialize(hits, "judged")
    garbled = hits.where("firm").select(F.col("form").alias("word")).distinct()
    long = F.length(F.regexp_replace("form", r"[\x00-\x7F]", "")) >= 3
    return hits.join(garbled, "word", "left_anti").select("form", "word", "chain", "docs", "firm", (F.col("plain") | (F.col("firm") & long)).alias("sure"))


def clean_characters(vocabulary: DataFrame, fixes: DataFrame) -> DataFrame:
    """``(word, docs)``: non-ASCII characters that more distinct texts, or more
    documents with copies, have in words that are no garbled form than in garbled
    ones. Words of one document only, which may be garbled in part, tell for a
    character where :data:`LONE` of them have it and twice as many as garbled ones."""
    bad = vocabulary.join(fixes.where("firm").select(F.col("form").alias("word"), F.lit(1).alias("bad_")).distinct(), "word", "left")
    kind = F.when(F.col("bad_").isNotNull() | _damaged("word"), "poor").when(F.col("copies") < 2, "lone").otherwise("good")
    per = bad.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c"), kind.alias("kind_"), "docs", "copies").where(F.col("c").rlike(r"[^\x00-\x7F]"))
    tally = [F.sum(F.when(F.col("kind_") == k, F.col(n)).otherwise(0)).alias(f"{k}_{n}") for n in ("docs", "copies") for k in ("good", "lone", "poor")]
    per = per.groupBy("c").agg(*tally).where(f"good_docs > poor_docs or good_copies > poor_copies or (lone_docs >= {LONE} and good_docs + lone_docs > {RATIO} * poor_docs)")
    return per.select(F.col("c").alias("word"), (F.col("good_docs") + F.col("lone_docs")).alias("docs"))


def _grams(word: Column) -> Column:
    """All runs of 2 to :data:`LONGEST` characters of a word, cut from the array
    of its characters: linear in the word's length."""
    chars = F.split(word, "")
    n = F.length(word)
    return F.array_distinct(
        F.flatten(
            F.transform(
                F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))),
                lambda i: F.transform(F.sequence(F.lit(2), F.greatest(F.least(F.lit(LONGEST), n - i + 1), F.lit(2))), lambda k: F.array_join(F.slice(chars, i, k), "")),
            )
        )
    )


def _repairs() -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Per word and chain: the text with the matched forms put right, how many
    places that were, and whether they cover all its non-ASCII characters."""

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            out = []
            for form, chain, pairs in zip(p["form"], p["chain"], p["pairs"]):
                table = {r["f"]: r["c"] for r in pairs}
                longest = max(map(len, table))
                text, i, hits, rest = [], 0, 0, 0
                while i < len(form):
                    for k in range(min(longest, len(form) - i), 1, -1):
                        c = table.get(form[i : i + k])
                        if c is not None:
                            text.append(c)
                            hits += 1
                            i += k
                            break
                    else:
                        rest += form[i] > "\x7f"
                        text.append(form[i])
                        i += 1
                out.append((form, chain, "".join(text), hits, rest == 0))
            yield pd.DataFrame(out, columns=["form", "chain", "word", "hits", "whole"])

    return work


def character_fixes(vocabulary: DataFrame, fixes: DataFrame, chars: DataFrame) -> DataFrame:
    """``(form, word, chain, firm, sure)`` for words of which only a part is
    garbled, or whose original stands nowhere else in the corpus.

    The garbled forms of every clean character under the multi-byte chains are
    hash-joined with the character runs of the words left over. A repaired word
    is sure if it is a clean corpus word itself, or if UTF-8 explains two places
    or all non-ASCII characters of it, or one with a sign in its form and a
    character that clean words do not use. Pairs of East Asian bytes are nearly all taken, so that two letters
    stand for a character by chance: a repair by these sets needs two places and
    such an unused character. Without one it must cover a whole word without
    Latin letters, in two places or more, and is a candidate for texts in which
    most words can be read so.
    """
    forms = chars.mapInPandas(_form_rows(False, 2), _FORMS).where(F.length("form") <= LONGEST)
    # a lone ASCII character beside a non-ASCII one is too little evidence
    forms = forms.where(~F.col("form").rlike(r"[\x00-\x7F]") & ~F.contains("form", F.lit(_LOST)))
    strange = (
        forms.select("form", F.explode(F.array_distinct(F.split("form", ""))).alias("c"))
        .join(chars.select(F.col("word").alias("c"), F.lit(1).alias("known")), "c", "left")
        .groupBy("form")
        .agg((F.max(F.col("known").isNull()) & F.col("form").rlike(r"[^\p{L}\p{M}\x00-\x7F]")).alias("strange"))
    )
    forms = materialize(forms.join(strange, "form").withColumn("chain", F.explode("chains")).drop("chains"), "forms")
    # an undamaged word that is a firm form of another one is left to that
    rest = vocabulary.join(fixes.where("firm").select(F.col("form").alias("word")), "word", "left_anti").where(F.length("word") >= 2)
    grams = rest.select("word", F.explode(_grams(F.col("word"))).alias("form"))
    pairs = (
        grams.select(F.col("word").alias("whole_"), "form")
        .join(small_side(forms), "form")
        .groupBy(F.col("whole_").alias("w_"), "chain")
        .agg(F.collect_set(F.struct(F.col("form").alias("f"), F.col("word").alias("c"))).alias("pairs"), F.max("strange").alias("strange"))
        .select(F.col("w_").alias("form"), "chain", "pairs", "strange")
    )
    pairs = materialize(pairs, "matches")
    done = pairs.select("form", "chain", "pairs").mapInPandas(_repairs(), "form string, chain string, word string, hits int, whole boolean")
    done = done.join(pairs.select("form", "chain", "strange"), ["form", "chain"])
    known = rest.where(~_damaged("word")).select("word", F.lit(True).alias("known"))
    done = done.join(known, "word", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    unicode = F.startswith("chain", F.lit("utf-8>"))
    sure = F.col("known") | (F.col("strange") & (unicode | (F.col("hits") >= 2))) | (unicode & (F.col("whole") | (F.col("hits") >= 2)))
    many = F.col("whole") & (F.col("hits") >= 2) & ~F.col("form").rlike("[A-Za-z]")
    good = done.withColumn("sure", sure).where(F.col("sure") | many)
    one = F.row_number().over(Window.partitionBy("form", "chain").orderBy(F.desc("known"), F.desc("whole"), F.desc("hits"), F.length("word"), "word"))
    return good.withColumn("r_", one).where("r_ = 1").select("form", "word", "chain", "sure", "known")


def undone(form: str, chain: str, tables: dict[str, list[str]], inverse: dict[str, dict[str, int]]) -> str | None:
    """``form`` read back through ``chain``; null where that is impossible, changes
    nothing, or does not lead to ``form`` again."""
    steps = chain.split(">")
    text = form
    for enc, dec in reversed(list(zip(steps[::2], steps[1::2]))):
        if dec not in inverse:
            return None
        try:
            raw = bytes([inverse[dec][c] for c in text])
            text = "".join([tables[enc][b] for b in raw]) if enc in tables else raw.decode(enc)
        except (KeyError, UnicodeDecodeError):
            return None
    return text if text != form and (form, chain) in garbled_forms(text, tables) else None


def _undo_rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    tables = _tables()
    inverse = {n: {c: b for b, c in enumerate(row)} for n, row in tables.items()}
    for p in parts:
        word = [undone(f, c, tables, inverse) for f, c in zip(p["form"], p["chain"])]
        yield pd.DataFrame({"form": p["form"], "chain": p["chain"], "word": word}).dropna()


def garbled_words(df: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """``(evidence, fixes)``: ``(id_, text_, form, word, chain)`` of garbled words
    in documents, and ``(form, word, chain, n_texts)`` of distinct ones; ``word``
    is null where the original cannot be told.

    What a word stands for is decided text by text. A candidate counts if it is
    sure, if two firm words of the text share its chain (a rare word may equal
    another one's garbled form by chance), or, for unsure repairs by East Asian
    sets, if two words and more than half of the text's words share it. Of several
    candidates the one whose chain explains most words of the text is taken, then
    that found as a word, that of most texts, the shorter word, and the first. A
    form with a replacement character stays without an original if candidates
    that explain equally many words differ. Words of a text that has such a chain
    but of which the corpus has no original are read back through the chain, if
    that gives clean characters only and leads to the same form again.
    """
    words, vocabulary = corpus_words(df, key, text)
    by_word = materialize(word_fixes(words, vocabulary), "word_fixes")
    chars = materialize(clean_characters(vocabulary, by_word), "characters")
    by_char = character_fixes(vocabulary, by_word, chars)
    whole, part, no = F.lit(0), F.lit(1), F.lit(False)
    cands = by_word.select("form", "word", "chain", "docs", "firm", "sure", whole.alias("kind")).union(
        by_char.select("form", "word", "chain", F.lit(0).cast("long"), no, "sure", part)
    )
    cands = materialize(cands, "candidates")
    texts = words.select("text_", F.col("word").alias("form"))
    at = materialize(texts.join(small_side(cands), "form").distinct(), "spots")
    per = at.groupBy("text_", "chain").agg(
        F.count_distinct("form").alias("n_"),
        F.count_distinct(F.when(F.col("firm"), F.col("form"))).alias("firm_"),
        F.count_distinct(F.when((F.col("kind") == 1), F.col("form"))).alias("part_"),
        F.max("sure").alias("sure_"),
    )
    # how many words a text has matters only to those with unsure repairs
    unsure = at.where("kind = 1 and not sure").select("text_").distinct()
    wide = texts.join(small_side(unsure), "text_", "left_semi").groupBy("text_").agg(F.count_distinct("form").alias("words_"))
    per = materialize(per.join(wide, "text_", "left"), "chains")
    shown = (F.col("firm_") >= 2) & (F.col("kind") == 0) | (F.col("part_") >= 2) & (F.col("part_") * 2 > F.col("words_")) & (F.col("kind") == 1)
    kept = at.join(per, ["text_", "chain"]).where(F.col("sure") | F.coalesce(shown, no))
    order = (F.desc("n_"), "kind", F.desc("docs"), F.length("word"), "chain", "word")
    best = F.row_number().over(Window.partitionBy("text_", "form").orderBy(*order))
    top = Window.partitionBy("text_", "form")
    split = F.contains("form", F.lit(_LOST)) & (F.size(F.collect_set(F.when(F.col("n_") == F.col("top_"), F.col("word"))).over(top)) > 1)
    kept = kept.withColumn("top_", F.max("n_").over(top)).withColumn("split_", split).withColumn("r_", best).where("r_ = 1")
    kept = materialize(kept.select("text_", "form", F.when(~F.col("split_"), F.col("word")).alias("word"), "chain", "n_", "firm_", "sure_"), "kept")
    # what else these texts hold: read back through the chain that explains most
    lead = F.row_number().over(Window.partitionBy("text_").orderBy(F.desc("n_"), "chain"))
    shown = kept.where("n_ >= 2").select("text_", "chain", "n_").distinct().withColumn("r_", lead).where("r_ = 1").select("text_", "chain")
    left = texts.join(small_side(shown), "text_").distinct().join(kept.select("text_", "form"), ["text_", "form"], "left_anti")
    left = materialize(left, "unexplained")
    back = left.select("form", "chain").distinct().mapInPandas(_undo_rows, "form string, chain string, word string")
    back = back.select("*", F.explode(F.array_distinct(F.split("word", ""))).alias("c")).join(chars.select(F.col("word").alias("c"), F.lit(1).alias("known")), "c", "left")
    odd = F.col("known").isNull() & F.col("c").rlike(r"[^\x00-\x7F]")
    back = back.groupBy("form", "chain", "word").agg(F.max(odd).alias("odd")).where("not odd")
    more = left.join(back, ["form", "chain"]).select("text_", "form", "word", "chain")
    found = kept.select("text_", "form", "word", "chain").union(more)
    # damaged words in any other text: found, though their originals are lost
    damaged = texts.where(_damaged("form")).distinct().join(found.select("text_", "form"), ["text_", "form"], "left_anti")
    found = materialize(found.union(damaged.select("text_", "form", F.lit(None).cast("string"), F.lit("unknown"))), "found")
    fixes = found.groupBy("form", "word", "chain").agg(F.count(F.lit(1)).alias("n_texts"))
    ids = words.select("id_", "text_", F.col("word").alias("form")).join(small_side(found), ["text_", "form"])
    return ids.select("id_", "text_", "form", "word", "chain"), fixes


def restored(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(id_, text_, n_words, n_lost)`` of the affected documents.

    ``text_`` has every garbled word replaced by its verified original and
    numeric character references resolved; ``n_words`` distinct garbled words
    were found, of which ``n_lost`` cannot be restored and stand as they are.
    Documents without a garbled word give no row; a repeated id with garbled
    text gives one row for each of its texts.
    """
    evidence, _ = garbled_words(df, key, text)
    per = evidence.groupBy("id_", F.col("text_").alias("hash_")).agg(
        F.map_from_entries(F.collect_set(F.struct("form", F.coalesce("word", "form").alias("word")))).alias("fix_"),
        F.count_distinct("form").cast("int").alias("n_words"),
        F.count_distinct(F.when(F.col("word").isNull(), F.col("form"))).cast("int").alias("n_lost"),
    )
    rows = df.select(F.col(key).cast("long").alias("id_"), resolved(F.col(text)).alias("t_")).withColumn("hash_", F.xxhash64("t_"))
    parts = F.regexp_extract_all("t_", F.lit(_PIECE), F.lit(0))
    fixed = F.array_join(F.transform(parts, lambda x: F.coalesce(F.try_element_at("fix_", x), x)), "")
    return rows.join(per, ["id_", "hash_"]).select("id_", fixed.alias("text_"), "n_words", "n_lost")
