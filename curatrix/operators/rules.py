"""Rules over instruction records: guards, rewrites and score thresholds, by edit type.

A rule is a Column over the record's columns, so that Catalyst puts all rules of a query into one projection or
filter. A rule that is null rejects, as one that is false does; see passes().
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curatrix.functions import text as t
from curatrix.functions.sampling import draw, pick, sample

# The object that stands for all that have it in their name, and the directions.
BALL = "ball"
DIRECTIONS = ["left", "right", "upper", "down"]
# End of fixed values.
# Lists that decide results.
BASIC_COLORS = ["red", "blue", "green", "yellow", "black", "purple", "white", "pink", "orange", "gray", "brown", "gold", "silver"]
RARE_COLORS = ["violet", "indigo", "magenta", "cyan", "teal", "lime", "olive", "navy", "maroon", "coral", "turquoise", "tan", "salmon", "beige", "lavender", "mint", "aqua"]
COLOR_WEIGHTS = [0.8, 0.2]
PEOPLE = ["people", "man", "woman", "boy", "girl", "person"]
PEOPLE_REPLACED = ["people", "man", "woman", "boy", "girl", "person", "adult", "child"]
PEOPLE_RELATED = ["people", "man", "woman", "boy", "girl", "person", "adult", "child", "hand", "foot"]
HUMAN_ENDS = ["er", "or", "ist", "ian", "ee"]
SIZES = ["size", "bigger", "smaller", "longer", "shorter"]
CHECKED_COLORS = ["color", "white", "black", "green", "blue", "red", "grey", "pink"]
ROOMS = ["kitchen", "room", "bathroom", "bedroom", "wall"]
BE_AND_HAVE = ["be", "being", "have", "having"]
YES_WORDS = ["yes", "true", "right", "correct"]
REMOVE_VERBS = ["Remove", "Erase", "Elimate"]
LEFT_VERBS = ["Turn", "Make", "Let"]
PLACES = ["on the", "in the", "at the"]
CENTER = "location='in the center'"
LAYOUTS = ["right", "left", "bottom", "up"]
ROTATION_VERBS = ["Turn", "Make", "Rotate"]
NUMBER_WORDS = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine"]
# End of fixed values.

OBJECT_TYPES = ["remove", "replace", "appearance_alter", "color_alter"]


def passes(rule: Column) -> Column:
    return F.coalesce(rule, F.lit(False))


def by_type(rules: dict[str, Column], otherwise: Column | None = None) -> Column:
    """The rule of the row's edit_type."""
    out = None
    for kind, rule in rules.items():
        out = F.when(F.col("edit_type") == kind, rule) if out is None else out.when(F.col("edit_type") == kind, rule)
    return out if otherwise is None else out.otherwise(otherwise)


# --------------------------------------------------------------------------- before an edit


def has_new_background() -> Column:
    return F.col("new_background").isNotNull()


def appearance_guard() -> Column:
    said = t.words(t.strip(F.replace("input", F.lit(","), F.lit("")), "."))
    return F.col("edited_object").isNotNull() & F.array_contains(said, t.last_word(F.col("edited_object"))) & ~t.has_word(F.col("edit"), F.lit("color"))


def pre_guard() -> Column:
    return by_type({
        "background_change": has_new_background(), "appearance_alter": appearance_guard(),
        "remove": F.col("edited_object").isNotNull(), "replace": F.col("edited_object").isNotNull(),
    }, F.lit(True))


def aspect_ratio(w: Column, h: Column, most: float = 2.0) -> Column:
    return F.greatest(w, h) / F.least(w, h) <= most


def generic_filter(clip: Column, aesthetic: Column, object_share: Column, w: Column, h: Column) -> Column:
    """The one conjunction of all checks before an edit."""
    small = F.when(F.col("edit_type").isin(OBJECT_TYPES), object_share < 0.95).otherwise(True)
    return pre_guard() & aspect_ratio(w, h) & (clip > 0.1) & (aesthetic > 2) & small


def appearance_words() -> Column:
    edit = F.col("edit")
    return ~(t.has_any(t.after_last(edit, "to "), PEOPLE) | t.has_any(t.after_last(edit, "into "), PEOPLE) | t.has_any(edit, SIZES))


def not_human(word: Column) -> Column:
    return ~(word.isin(PEOPLE_REPLACED) | t.ends_with_any(word, HUMAN_ENDS))


def replace_words(lemma: Column | None = None) -> Column:
    """lemma: that of the new object's last word, where a lexicon gives one."""
    word = t.last_word(F.col("new_object"))
    return not_human(word) & (F.lit(True) if lemma is None else F.coalesce(not_human(lemma), F.lit(True)))


def background_words(current: Column) -> Column:
    new = t.last_word(F.col("new_background"))
    return ~(F.array_contains(t.words(t.strip(current, ".")), new) | F.array_contains(t.words(t.strip(F.col("input"), ".")), new))


def foreground(nouns: Column, current: Column) -> Column:
    """Nouns that are neither in the background's words nor rooms, in order, with repeats."""
    seen = F.concat(t.words(t.strip(current, ".")), F.array(*map(F.lit, ROOMS)))
    return F.filter(nouns, lambda n: ~F.array_contains(seen, n))


def action_cut(edit: Column, said: Column, output: Column, lexicon: Column) -> tuple[Column, Column, Column]:
    """(kept, input, output) of an edit to another action. lexicon: a map of verb forms to lemmas; what it lacks is its
    own lemma and no verb. The clauses of input and output go side by side, as many as the shorter has, up to and with
    the first in which a word of the output has the lemma of the new action. Not kept are be and have, and edits whose
    clause of the input at that place has no verb, or has that action already; edits without such a clause are."""
    lemma = lambda w: F.coalesce(lexicon[w], w)
    new = t.first_word(t.after_last(edit, "to "))
    clauses = F.filter(F.arrays_zip(F.split(said, ", ").alias("i"), F.split(output, ", ").alias("o")), lambda c: c["i"].isNotNull() & c["o"].isNotNull())
    hit = F.array_position(F.transform(clauses, lambda c: F.exists(t.words(t.strip(c["o"], ".")), lambda w: lemma(w) == lemma(new))), True)
    verbs = F.transform(F.filter(t.words(t.strip(F.element_at(clauses, hit.cast("int"))["i"], ".")), lambda w: lexicon[w].isNotNull()), lemma)
    done = F.when(hit > 0, (F.size(verbs) == 0) | F.array_contains(verbs, lemma(new)) | F.array_contains(verbs, new)).otherwise(False)
    cut = F.when(hit > 0, F.slice(clauses, F.lit(1), hit.cast("int"))).otherwise(clauses)
    return ~new.isin(BE_AND_HAVE) & ~done, F.array_join(F.transform(cut, lambda c: c["i"]), ", "), F.array_join(F.transform(cut, lambda c: c["o"]), ", ")


def named_parts(kind: Column, said: Column, tags: Column) -> Column:
    """Whether a caption has what its edit type needs, by tags, a map of words to parts of speech: a verb for a change of
    action, else a noun."""
    need = F.when(kind == "action_change", "VERB").otherwise("NOUN")
    return F.exists(t.words(t.strip(said, ".")), lambda w: F.coalesce(tags[w] == need, F.lit(False)))


def noun_concepts(words: DataFrame, tags: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(concept): the lemmas, in lower case, of the words (word) that tags (word, pos, entity, lemma) call nouns or
    names but not persons, and that are in the vocabulary (word), whatever their case. All three may be large: they meet
    in joins on the word."""
    nouns = tags.where(F.col("pos").isin("NOUN", "PROPN") & (F.coalesce("entity", F.lit("")) != "PERSON"))
    known = vocabulary.select(F.lower("word").alias("known")).distinct()
    found = words.select("word").distinct().join(nouns.select("word", "lemma"), "word").join(known, F.lower("word") == F.col("known"), "left_semi")
    return found.select(F.lower("lemma").alias("concept")).distinct()


def complete() -> Column:
    return F.col("input").isNotNull() & F.col("output").isNotNull() & F.col("edit").isNotNull() & (F.col("input") != F.col("output"))


def says_yes(answer: Column) -> Column:
    return F.contains(F.lower(answer), F.lit("yes"))


def names_no_color() -> Column:
    return ~t.has_any(F.col("edit"), CHECKED_COLORS)


def one_quoted_text() -> Column:
    return t.count_of(F.col("input"), "'") == 2


def driver_guard() -> Column:
    """Whether an edit of the row's type is tried at all; the others are skipped, neither success nor failure."""
    obj, edit = F.col("edited_object"), F.col("edit")
    named = obj.isNotNull() & F.contains(edit, obj) & ~F.contains(edit, F.lit("background"))
    rules = dict.fromkeys(("add", "remove", "counting"), named)
    return by_type(rules | {"replace": named & F.col("new_object").isNotNull(), "background_change": has_new_background()}, F.lit(True))


def verdict(tried: Column, made: Column, failed: Column | None = None) -> Column:
    """skipped, error, success or failure: each row has one, so none gets lost between the sinks."""
    out = F.when(~passes(tried), "skipped")
    if failed is not None:
        out = out.when(passes(failed), "error")
    return out.when(passes(made), "success").otherwise("failure")


def replace_share(share: Column) -> Column:
    return ~F.col("edited_object").isin(PEOPLE) & ~F.col("new_object").isin(PEOPLE) & share.between(0.05, 0.95)


# --------------------------------------------------------------------------- after an edit


def affirmative(answer: Column) -> Column:
    return F.arrays_overlap(F.split(answer, " "), F.array(*map(F.lit, YES_WORDS)))


def variant_path(path: Column, anywhere: bool = False) -> Column:
    """Whether a file is a first or second variant; anywhere: also where the mark is inside the path."""
    return path.rlike("_[12]" if anywhere else r"_[12]\.\w+$")


def post_rules(s: dict[str, Column]) -> dict[str, Column]:
    """Thresholds by edit type; s: columns clip, clip_dir, l1, vqa, detected, detected_new, ocr_src, ocr_dst."""
    quotes = t.quoted(F.col("edit"))
    return {
        "add": (s["clip"] > 0.2) & s["detected"],
        "replace": (s["clip"] > 0.2) & (s["clip_dir"] > 0.08) & s["detected_new"],
        "remove": (s["clip"] > 0.15) & ~s["detected"],
        "action_change": (s["clip"] > 0.3) & (s["clip_dir"] > 0.05),
        "appearance_alter": (s["clip"] > 0.25) & (s["l1"] > 0.3) & (s["clip_dir"] > 0.06),
        "tone_transfer": (s["clip"] > 0.25) & (s["l1"] > 0.2) & (s["l1"] < 0.8),
        "background_change": (s["clip"] > 0.15) & s["vqa"] & (s["l1"] > 0.2) & (s["l1"] < 0.9),
        "color_alter": (s["clip"] > 0.2) & (s["l1"] > 0.3) & s["vqa"],
        "textual": (F.size(quotes) == 2) & F.contains(s["ocr_src"], F.get(quotes, F.lit(0))) & F.contains(s["ocr_dst"], F.get(quotes, F.lit(1))),
    }


def selected(records: DataFrame, scores: dict[str, Column]) -> DataFrame:
    """records with `selected`: whether the row passes its type's thresholds; types without thresholds never do."""
    return records.withColumn("selected", passes(by_type(post_rules(scores))))


# --------------------------------------------------------------------------- rewrites


def recolored(edit: Column, output: Column, color: Column) -> tuple[Column, Column]:
    """(edit, output) with another colour; null where the edit names none."""
    now = t.part_after(edit, "to ")
    return F.when(now.isNotNull(), F.concat(F.split_part(edit, F.lit("to "), F.lit(1)), F.lit("to "), color)), F.replace(output, now, color)


def reworded(edit: Column, verb: str) -> Column:
    """The edit with its first word replaced by `verb`, two spaces after it."""
    w = t.words(edit)
    return F.concat(F.lit(verb + "  "), F.array_join(F.slice(w, F.lit(2), F.size(w)), " "))


def referenced(edit: Column, obj: Column, said: Column) -> tuple[Column, Column]:
    """(edit, input) that point to a reference picture: the first word of the input equal to the object becomes [V*]."""
    w = t.words(said)
    at = F.array_position(w, obj)
    return F.concat(t.first_word(edit), F.lit(" the "), obj, F.lit(" to the [V*]")), F.array_join(F.transform(w, lambda x, i: F.when(i + 1 == at, F.lit("[V*]")).otherwise(x)), " ")


def moved(verb: Column, obj: Column, direction: Column, target: Column) -> Column:
    """The sentence that moves an object, beside a target or, where that is null, by itself."""
    start = F.concat(verb, F.lit(" the "), obj)
    to = F.concat(F.lit(" the "), target)
    near = F.when(direction == "left", F.concat(start, F.lit(" to left of"), to)).when(direction == "right", F.concat(start, F.lit(" to right of"), to))
    near = near.when(direction == "down", F.concat(start, F.lit(" under"), to)).otherwise(F.concat(start, F.lit(" on the top of"), to))
    return F.when(target.isNull(), F.concat(start, F.lit(" to "), direction)).otherwise(near)


def counted_noun(caption: Column, nouns: Column) -> Column:
    """The first of the nouns that a number from 2 to 9, digit or word, stands before, as a struct (noun, said, n): said
    is the last word, by single spaces, before the noun's first place."""
    digits = F.array(*[F.lit(str(i)) for i in range(len(NUMBER_WORDS))])
    said = lambda n: t.last_word(F.trim(F.split_part(caption, n, F.lit(1))))
    number = lambda w: F.greatest(F.array_position(digits, w), F.array_position(F.array(*map(F.lit, NUMBER_WORDS)), w)) - 1
    found = F.transform(nouns, lambda n: F.struct(n.alias("noun"), said(n).alias("said"), number(said(n)).cast("int").alias("n")))
    return F.get(F.filter(found, lambda x: x["n"] > 1), F.lit(0))


def counted(caption: Column, found: Column, key: Column) -> tuple[Column, Column, Column]:
    """(edit, output, removed) for a caption and its counted_noun(): how many go, the wording and the verbs are draws.
    Numbers are told in words; the output changes a number that the caption tells in words."""
    names = F.array(*map(F.lit, NUMBER_WORDS))
    name = lambda n: F.get(names, n)
    gone = (draw(key, "gone") % found["n"] + 1).cast("int")
    left, noun, now = name(found["n"] - gone), found["noun"], name(found["n"])
    verb, turn = (pick(F.array(*map(F.lit, words)), key, seed) for words, seed in ((REMOVE_VERBS, "remove"), (LEFT_VERBS, "left")))
    to = F.concat(F.lit(" from "), now, F.lit(" to "), left)
    edits = F.array(
        F.concat(verb, F.lit(" "), name(gone), F.lit(" of the "), noun, F.lit(" in the image")),
        F.concat(turn, F.lit(" the total number of the "), noun, to),
        F.concat(verb, F.lit(" "), name(gone), F.lit(" of the "), noun, F.lit(" to "), F.lower(turn), F.lit(" the total number"), to),
    )
    output = F.replace(caption, F.concat(F.lit(" "), now, F.lit(" "), noun), F.concat(F.lit(" "), left, F.lit(" "), noun))
    return pick(edits, key, "counting"), output, gone


def rotation_direction(q: Column) -> Column:
    """left or right, by where the axis of a turn (w, x, y, z) points, taken as the turn of less than half a circle."""
    return F.when(q[2] * F.signum(q[0]) > 0, "left").otherwise("right")


def rotations(turns: DataFrame, sequence: str, order: str) -> DataFrame:
    """turns with `swapped`: whether the direction was there before in its sequence."""
    return turns.withColumn("swapped", F.row_number().over(Window.partitionBy(sequence, "direction").orderBy(order)) > 1)


def rotation_edit(key: Column, obj: Column, direction: Column, swapped: Column) -> Column:
    verb = pick(F.array(*map(F.lit, ROTATION_VERBS)), key, "turn")
    return F.concat(verb, F.lit(" the "), obj, F.when((direction == "right") == ~swapped, " clockwise").otherwise(" counterclockwise"))


def located(rows: DataFrame, caption: str, key: str, backgrounds: DataFrame, k: int = 10) -> DataFrame:
    """rows with one caption for each way to say where: the one that there is, if its last 20 characters name a place; else
    k with a background each, of the table `backgrounds` (background, pos from 0 on, as many as rows), of as many of them
    as there are if fewer: neighbours in that order from a drawn one on, so none comes twice. Null captions stay as one
    row. Drawn places and backgrounds meet in a join, so neither has to be small."""
    placed = F.coalesce(t.has_any(F.right(F.col(caption), F.lit(20)), PLACES), F.lit(True))
    whole = rows.withColumns({"placed": placed, "n": backgrounds.agg(F.count("*").alias("n")).scalar()})
    at = F.transform(F.sequence(F.lit(0), F.least(F.lit(k), F.col("n")) - 1), lambda i: (draw(F.col(key), "place") + i) % F.col("n"))
    made = whole.where("not placed and n > 0").withColumn("at", F.explode(at)).join(backgrounds.withColumnRenamed("pos", "at"), "at")
    made = made.withColumn(caption, F.concat(t.strip(F.col(caption), "."), F.lit(" "), "background", F.lit(".")))
    return whole.where("placed or n = 0").select(*rows.columns).union(made.select(*rows.columns))


def canonical(found: Column, target: Column) -> tuple[Column, Column]:
    """Names as the detector knows them: what has a ball in it is one, and a direction is no target."""
    return F.when(F.contains(found, F.lit(BALL)), BALL).otherwise(found), F.when(~target.isin(DIRECTIONS), target)


def layouts(layout: Column, regions: int = 3) -> Column:
    """Variants (relation, layout) of the first regions of a layout: one as it is, or, if something stands in the
    center, one for each place that it may move to."""
    head = F.concat(F.array_join(F.slice(F.split(layout, "\n\n#"), 1, regions), "\n\n#"), F.lit("\n```"))
    moved = [F.struct(F.lit(to).alias("relation"), F.replace(head, F.lit(CENTER), F.lit(CENTER.replace("center", to))).alias("layout")) for to in LAYOUTS]
    return F.when(F.contains(head, F.lit(CENTER)), F.array(*moved)).otherwise(F.array(F.struct(F.lit("ori").alias("relation"), head.alias("layout"))))


def sessions(turns: DataFrame, session: str, order: str, start: Column, step: Callable[[Column, Column], Column]) -> DataFrame:
    """(session, turns, history, done) of rows of turns: a fold over the turns of each session, in order and however many.
    step(state, turn) gives, from what the turn before gave (start for the first) and the turn, a struct of its columns,
    what this one gives; a null ends the session, and is not done. history: what the turns gave up to there. A session is
    one row, as a conversation must be; repeated values of order count in any order."""
    turn = F.struct(order, *[c for c in turns.columns if c not in (session, order)])
    rows = turns.groupBy(session).agg(F.array_sort(F.collect_list(turn)).alias("all"))
    begin = F.struct(F.lit(True).alias("on"), start.cast("string").alias("last"), F.array().cast("array<string>").alias("history"))

    def fold(state: Column, turn: Column) -> Column:
        new = step(state["last"], turn)
        on = state["on"] & new.isNotNull()
        return F.struct(on.alias("on"), F.when(on, new).otherwise(state["last"]).alias("last"), F.when(on, F.array_append(state["history"], new)).otherwise(state["history"]).alias("history"))

    rows = rows.select(session, F.size("all").alias("turns"), F.aggregate("all", begin, fold).alias("end"))
    return rows.select(session, "turns", "end.history", F.col("end.on").alias("done"))
