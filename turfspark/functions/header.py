"""Fields of the two header texts of a race, and of the tokens on a race card."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..vocab import CLASSES, CONDITIONS, DIRECTIONS, GROUND, OLD_CLASSES, PLACES, SEXES
from .parsing import ascii_digits, found, japanese_date


def last_listed(text: Column, words) -> Column:
    """The last word of the list that the text contains."""
    return F.coalesce(*[F.when(text.contains(w), F.lit(w)) for w in reversed(list(words))])


def first_listed(text: Column, words) -> Column:
    return F.coalesce(*[F.when(text.contains(w), F.lit(w)) for w in words])


def _part(text: Column, sep: str, n: int) -> Column:
    return F.trim(F.get(F.split(text, sep), F.lit(n)))


def ground_states(field: Column) -> tuple[Column, Column]:
    """Of ``芝 : 良``: both 良; of a jump's ``障芝 : 良 ダート : 稍重``: one each; else null."""
    n = F.size(F.split(field, ":")) - 1
    first = F.get(F.split(_part(field, ":", 1), r"\s+"), F.lit(0))
    second = F.when(n == 2, _part(field, ":", 2)).when(n == 1, _part(field, ":", 1))
    known = lambda c: F.when(c.isin(*GROUND), c)
    return known(F.when(n.isin(1, 2), first)), known(second)


def condition_flags(df: DataFrame, text: str = "condition", rest: str | None = None) -> DataFrame:
    """A 0/1 column for each condition word; a word found is taken out before the next is looked for, so
    ``指`` hides ``特指``. ``rest`` names a column for what is left of the text. One pass over the words, which carries
    the rest of the text and a bit for each word found; a word that isn't there changes nothing."""
    words = F.array(*[F.struct(F.lit(w).alias("word"), F.lit(1 << i).alias("bit")) for i, w in enumerate(CONDITIONS)])
    begin = F.struct(F.coalesce(F.col(text), F.lit("")).alias("rest"), F.lit(0).alias("bits"))
    taken = lambda x, w: F.struct(F.replace(x["rest"], w["word"], F.lit("")).alias("rest"), (x["bits"] + w["bit"]).alias("bits"))
    done = df.withColumn("_words", F.aggregate(words, begin, lambda x, w: F.when(x["rest"].contains(w["word"]), taken(x, w)).otherwise(x)))
    flags = {name: (F.col("_words.bits").bitwiseAND(F.lit(1 << i)) > 0).cast("int") for i, name in enumerate(CONDITIONS.values())}
    return done.withColumns(flags | ({rest: F.trim("_words.rest")} if rest else {})).drop("_words")


def race_class(text: Column, grade: Column | None = None, hurdle: Column | None = None) -> Column:
    """Class label of a condition text: full-width digits and names of before 2019 count; of several words
    the last of the list; a grade in the title or a hurdle race overrides."""
    label = _class_of(ascii_digits(text))
    if grade is not None:
        label = F.coalesce(first_listed(grade, ("G3", "G2", "G1")), label)
    return label if hurdle is None else F.when(hurdle, F.lit("障害")).otherwise(label)


def _class_of(plain: Column) -> Column:
    old = F.coalesce(*[F.when(plain.contains(k), F.lit(v)) for k, v in sorted(OLD_CLASSES.items(), key=lambda x: -len(x[0]))])
    return F.coalesce(last_listed(plain, CLASSES), old)


def parse_race_header(df: DataFrame, text1: str = "text1", text2: str = "text2") -> DataFrame:
    """Adds every field of the header texts ``芝右1600m / 天候 : 晴 / 芝 : 良 / 発走 : 10:05`` and
    ``2024年2月3日 1回東京3日目 3歳未勝利 牝(混)[指](馬齢)``."""
    one, two = F.col(text1), F.col(text2)
    # parts that several fields use are columns of their own, so that none is worked out for each use
    parts = {
        "_course": _part(one, "/", 0), "_weather": _part(one, "/", 1), "_surface": _part(one, "/", 2), "_meeting": _part(two, " ", 1),
        "_condition": F.trim(F.regexp_replace(two, r"^\S+\s+\S+\s*", "")),
    }
    df = df.withColumns(parts).withColumns({"_plain": ascii_digits(F.col("_condition")), "_place": last_listed(F.col("_meeting"), PLACES)})
    course, surface, meeting, condition, place = (F.col(f"_{c}") for c in ("course", "surface", "meeting", "condition", "place"))
    jump = F.startswith(course, F.lit("障"))
    state1, state2 = ground_states(surface)
    codes = F.create_map(*[F.lit(x) for p in PLACES.items() for x in p])
    fields = {
        "course_len": found(course, r"(\d+)\D*$").try_cast("int"),
        "weather": _part(F.col("_weather"), ":", 1),
        "race_type": _part(surface, ":", 0),
        "time": found(one, r"(\d{1,2}\s*:\s*\d{2})\s*$"),
        "date": japanese_date(two),
        "times": found(meeting, r"(\d+)回").try_cast("int"),
        "days": found(meeting, r"(\d+)日目").try_cast("int"),
        "place": place,
        "place_id": F.element_at(codes, place),
        "around": F.when(jump, F.lit("直線")).otherwise(F.coalesce(first_listed(course, DIRECTIONS), F.lit("直線"))),
        "ground_state1": state1,
        "ground_state2": state2,
        "age": F.concat(found(condition, r"(\d+)歳"), F.when(condition.contains("歳以上"), F.lit("+")).otherwise(F.lit(""))),
        "sex": last_listed(condition, SEXES),
        "race_class": _class_of(F.col("_plain")),
    }
    out = condition_flags(df.withColumns(fields).drop("_course", "_weather", "_surface", "_meeting", "_plain", "_place"), "_condition", "_rest")
    rest = F.regexp_replace("_rest", r"\d+歳(以上)?", "")
    rest = reduce(lambda c, w: F.replace(c, F.lit(w), F.lit("")), (*SEXES, *sorted(CLASSES, key=len, reverse=True), "()", "[]"), rest)
    return out.withColumn("race_condition", F.nullif(F.trim(F.regexp_replace(rest, r"\s+", " ")), F.lit(""))).drop("_condition", "_rest")


def card_race_fields(df: DataFrame, text: str = "text", grade: str | None = "grade") -> DataFrame:
    """Fields of the text above a race card; words are looked for anywhere in it, of several the last listed."""
    t = F.col(text)
    hurdle = t.contains("障")
    fields = {
        "course_len": found(t, r"(\d+)m").try_cast("int"),
        "weather": found(t, r"天候\W*(小雨|小雪|晴|曇|雨|雪)"),
        "ground_state": F.when(t.contains("不"), F.lit("不良")).when(t.contains("稍"), F.lit("稍重")).otherwise(found(t, r"馬場\W*(良|重)")),
        "race_type": F.when(hurdle, F.lit("障害")).when(t.contains("ダ"), F.lit("ダート")).when(t.contains("芝"), F.lit("芝")),
        "around": F.when(hurdle, F.lit("直線")).otherwise(last_listed(t, DIRECTIONS)),
        "race_class": race_class(t, F.col(grade) if grade else None, hurdle),
    }
    return df.withColumns(fields)
