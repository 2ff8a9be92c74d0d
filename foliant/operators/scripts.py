"""Languages by their scripts, and what a text is read as when its marks and metadata disagree with it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import language_key, let
from .language import by_stop_words

# Ranges of scripts by the language they stand for; the first that counts most wins.
SCRIPTS = {
    "bn": r"\x{0980}-\x{09FF}", "hi": r"\x{0900}-\x{097F}", "pa": r"\x{0A00}-\x{0A7F}", "gu": r"\x{0A80}-\x{0AFF}", "or": r"\x{0B00}-\x{0B7F}", "ta": r"\x{0B80}-\x{0BFF}",
    "te": r"\x{0C00}-\x{0C7F}", "kn": r"\x{0C80}-\x{0CFF}", "ml": r"\x{0D00}-\x{0D7F}", "si": r"\x{0D80}-\x{0DFF}", "th": r"\x{0E00}-\x{0E7F}", "ar": r"\x{0600}-\x{06FF}",
    "he": r"\x{0590}-\x{05FF}", "ru": r"\x{0400}-\x{04FF}", "el": r"\x{0370}-\x{03FF}", "ja": r"\x{3040}-\x{30FF}", "ko": r"\x{AC00}-\x{D7AF}\x{1100}-\x{11FF}", "zh": r"\x{4E00}-\x{9FFF}",
}
LATIN = r"A-Za-z\x{00C0}-\x{024F}"
# Letters that tell languages of one script apart.
URDU, PERSIAN, ARABIC = "ٹڈڑںھہےۓ", "پچژگکی", "ةيكى"
UKRAINIAN, RUSSIAN, BELARUSIAN, SERBIAN, MACEDONIAN, SHARED, HARD = "іІїЇєЄґҐ", "ыЫэЭёЁ", "ўЎ", "ђЂћЋ", "ѓЃќЌѕЅ", "јЈљЉњЊџЏ", "ъЪ"
#: Share of the Latin letters that another script needs, and of kana among Han that make it Japanese.
LEAST_SHARE, KANA_SHARE = 0.25, 0.05


def _n(c: Column, letters: str) -> Column:
    return F.regexp_count(c, F.lit(f"[{letters}]"))


def arabic_script(c: Column, letters: Column) -> Column:
    urdu = _n(c, URDU)
    return F.when((urdu >= 2) & (urdu * 50 >= letters), "ur").when(_n(c, PERSIAN) > _n(c, ARABIC), "fa").otherwise("ar")


def cyrillic_script(c: Column, letters: Column) -> Column:
    russian, serbian, macedonian = _n(c, RUSSIAN), _n(c, SERBIAN), _n(c, MACEDONIAN)
    south = serbian + macedonian + _n(c, SHARED)
    return (
        F.when((south * 100 > letters) & (south > russian), F.when(macedonian > serbian, "mk").otherwise("sr"))
        .when(_n(c, BELARUSIAN) * 200 > letters, "be")
        .when(_n(c, UKRAINIAN) > russian, "uk")
        .when((russian * 1000 < letters) & (_n(c, HARD) * 100 > letters), "bg")
        .otherwise("ru")
    )


def script_language(c: Column) -> Column:
    """The language of a text's main script; null for Latin ones and texts without letters. A script counts from a quarter of the Latin letters on."""
    counts = F.array(*(F.struct(_n(c, r).alias("n"), F.lit(-i).alias("i"), F.lit(lang).alias("lang")) for i, (lang, r) in enumerate(SCRIPTS.items())))

    def of(best: Column) -> Column:
        japanese = (best["lang"] == "zh") & (_n(c, SCRIPTS["ja"]) > best["n"] * KANA_SHARE)
        found = F.when(japanese, "ja").when(best["lang"] == "ar", arabic_script(c, best["n"])).when(best["lang"] == "ru", cyrillic_script(c, best["n"])).otherwise(best["lang"])
        return F.when((best["n"] > 0) & (best["n"] >= _n(c, LATIN) * LEAST_SHARE), found)

    return let(F.array_max(counts), of)


# Languages in Latin letters, whose metadata a Latin text doesn't contradict.
LATIN_LANGUAGES = "en fr de es it pt nl sv no nb da fi pl cs sk ro hu tr id ms vi ca hr sl lt lv et tl sw af eu ga is la sq".split()


def resolved(docs: DataFrame, id_col: str, text_col: str, declared_col: str) -> DataFrame:
    """id, language: by script; else by common words, strictly where the metadata says English and loosely where it says nothing useful; else the metadata; else en. An empty text keeps what it declares."""
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_t"), language_key(F.col(declared_col)).alias("_d"))
    rows = rows.withColumn("_s", script_language(F.col("_t")))
    loose = by_stop_words(rows, id_col, "_t").withColumnRenamed("lang_found", "_loose")
    strict = by_stop_words(rows, id_col, "_t", least=20.0, lead=3.0).withColumnRenamed("lang_found", "_strict")
    x = rows.join(loose, id_col, "left").join(strict, id_col, "left")
    empty = F.trim("_t") == ""
    unknown = F.col("_d").isNull() | ~F.col("_d").isin(LATIN_LANGUAGES)
    words = F.when(~empty & unknown, F.col("_loose")).when(~empty & (F.col("_d") == "en"), F.col("_strict"))
    kept = F.when(F.col("_d").isNotNull() & (empty | ~unknown), F.col("_d"))
    return x.select(id_col, F.coalesce("_s", words, kept, F.lit("en")).alias("language"))
