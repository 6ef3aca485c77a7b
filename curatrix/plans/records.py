"""Queries over instruction records: text rewrites, guards, thresholds and verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from curatrix.functions import sampling as sm
from curatrix.functions import text as t
from curatrix.operators import rules as r
from curatrix.plans.base import query

C = F.col


def _list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _any(expr: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({expr}, '{w}')" for w in words) + ")"


# --------------------------------------------------------------------------- text


@query("SELECT row_id, string_split(edit, ' ')[1] AS first_word, string_split(edit, ' ')[-1] AS last_word FROM {instr} WHERE edit IS NOT NULL")
def f01_first_and_last_word(get):
    return get("instr").select("row_id", t.first_word(C("edit")).alias("first_word"), t.last_word(C("edit")).alias("last_word"))


@query("SELECT row_id, split_part(edit, 'to ', -1) AS tail FROM {instr}")
def f02_after_last(get):
    return get("instr").select("row_id", t.after_last(C("edit"), "to ").alias("tail"))


@query("SELECT row_id, CASE WHEN contains(edit, 'to ') THEN split_part(edit, 'to ', 2) END AS part FROM {instr}")
def f03_part_after(get):
    return get("instr").select("row_id", t.part_after(C("edit"), "to ").alias("part"))


@query("SELECT row_id, trim(input, '.') AS stripped FROM {instr}")
def f04_strip(get):
    return get("instr").select("row_id", t.strip(C("input"), ".").alias("stripped"))


@query("SELECT row_id, len(edit) - len(replace(edit, '''', '')) AS quotes FROM {instr}")
def f09_count_of_character(get):
    return get("instr").select("row_id", t.count_of(C("edit"), "'").alias("quotes"))


@query("SELECT row_id, right(input, 20) AS tail FROM {instr}")
def f10_right(get):
    return get("instr").select("row_id", F.right("input", F.lit(20)).alias("tail"))


@query("SELECT doc_id, regexp_replace(text, '[^\\x00-\\x7F]', '', 'g') AS plain, regexp_matches(text, '[0-9]') AS has_digit FROM documents")
def f14_f15_ascii_and_digits(get):
    return get("documents").select("doc_id", t.ascii_only(C("text")).alias("plain"), C("text").rlike("[0-9]").alias("has_digit"))


@query(r"SELECT doc_id, regexp_replace(text, '[^\p{L}\p{N}_\p{Z}\x09-\x0D\x1C-\x1F\x85]', '', 'g') AS plain, regexp_replace(text, '([\p{L}\p{N}_]+)-([\p{L}\p{N}_]+)', '\1\2', 'g') AS joined FROM documents")
def f13_drop_punctuation(get):
    return get("documents").select("doc_id", t.drop_punctuation(C("text")).alias("plain"), t.join_hyphens(C("text")).alias("joined"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def f36_json_field(get):
    return get("events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


# --------------------------------------------------------------------------- projections


@query("""SELECT row_id, edit_type, edit, CASE WHEN edit_type IN ('add', 'remove', 'replace', 'color_alter', 'appearance_alter') THEN edited_object END AS edited_object,
    CASE WHEN edit_type = 'replace' THEN new_object END AS new_object, CASE WHEN edit_type = 'background_change' THEN new_background END AS new_background FROM {instr}""")
def p01_parameters_by_type(get):
    only = lambda c, *kinds: F.when(C("edit_type").isin(*kinds), C(c)).alias(c)
    return get("instr").select("row_id", "edit_type", "edit", only("edited_object", "add", "remove", "replace", "color_alter", "appearance_alter"), only("new_object", "replace"), only("new_background", "background_change"))


@query("SELECT row_id, string_split(string_split(image_file, '.')[-2], '/')[-1] AS name FROM {instr}")
def p02_path_name(get):
    return get("instr").select("row_id", t.path_name(C("image_file")).alias("name"))


@query("SELECT row_id, split_part(split_part(image_file, '_', -1), '.', 1) AS key, concat('root/COCO_train2014_', split_part(image_file, '_', -1)) AS path FROM {instr}")
def p03_p04_key_and_path(get):
    f = C("image_file")
    return get("instr").select("row_id", t.file_key(f).alias("key"), F.concat(F.lit("root/COCO_train2014_"), t.after_last(f, "_")).alias("path"))


_U = "('0x' || substr(md5('color-group|' || row_id), 1, 8))::BIGINT / 4294967296.0"
_P = "('0x' || substr(md5('color|' || row_id), 1, 8))::BIGINT"


@query(f"""WITH c AS (SELECT *, CASE WHEN {_U} < 0.8 THEN {_list(r.BASIC_COLORS)}[1 + {_P} % {len(r.BASIC_COLORS)}] ELSE {_list(r.RARE_COLORS)}[1 + {_P} % {len(r.RARE_COLORS)}] END AS color FROM {{instr}})
    SELECT row_id, concat(split_part(edit, 'to ', 1), 'to ', color) AS edit, replace(output, split_part(edit, 'to ', 2), color) AS output FROM c WHERE contains(edit, 'to ')""")
def p05_d02_recolored(get):
    color = sm.weighted(list(zip(r.COLOR_WEIGHTS, (r.BASIC_COLORS, r.RARE_COLORS), strict=True)), C("row_id"), "color")
    edit, output = r.recolored(C("edit"), C("output"), C("color"))
    return get("instr").withColumn("color", color).select("row_id", edit.alias("edit"), output.alias("output")).where("edit is not null")


@query("SELECT row_id, concat('Move  ', array_to_string(string_split(edit, ' ')[2:], ' ')) AS edit, 'movement' AS edit_type, CAST(NULL AS VARCHAR) AS output FROM {instr} WHERE edit_type = 'remove'")
def p06_reworded(get):
    return get("instr").where("edit_type = 'remove'").select("row_id", r.reworded(C("edit"), "Move").alias("edit"), F.lit("movement").alias("edit_type"), F.lit(None).cast("string").alias("output"))


@query("""WITH w AS (SELECT row_id, edit, string_split(edited_object, ' ')[-1] AS obj, string_split(input, ' ') AS w FROM {instr} WHERE edited_object IS NOT NULL AND input IS NOT NULL)
    SELECT row_id, concat(string_split(edit, ' ')[1], ' the ', obj, ' to the [V*]') AS edit,
        array_to_string(list_transform(w, lambda x, i: CASE WHEN i = list_position(w, obj) THEN '[V*]' ELSE x END), ' ') AS input FROM w""")
def p07_referenced(get):
    rows = get("instr").where("edited_object is not null and input is not null").withColumn("obj", t.last_word(C("edited_object")))
    edit, said = r.referenced(C("edit"), C("obj"), C("input"))
    return rows.select("row_id", edit.alias("edit"), said.alias("input"))


@query("""WITH d AS (SELECT row_id, edited_object AS o, new_object AS g, ['left', 'right', 'down', 'upper'][1 + row_id % 4] AS d FROM {instr} WHERE edited_object IS NOT NULL)
    SELECT row_id, d AS direction, CASE WHEN g IS NULL THEN concat('Move the ', o, ' to ', d) WHEN d = 'left' THEN concat('Move the ', o, ' to left of the ', g)
        WHEN d = 'right' THEN concat('Move the ', o, ' to right of the ', g) WHEN d = 'down' THEN concat('Move the ', o, ' under the ', g) ELSE concat('Move the ', o, ' on the top of the ', g) END AS edit FROM d""")
def p09_moved(get):
    d = F.get(F.array(*map(F.lit, ("left", "right", "down", "upper"))), (C("row_id") % 4).cast("int"))
    rows = get("instr").where("edited_object is not null").withColumn("direction", d)
    return rows.select("row_id", "direction", r.moved(F.lit("Move"), C("edited_object"), C("direction"), C("new_object")).alias("edit"))


@query("""SELECT event_id, CASE WHEN NOT contains(s, '}') THEN concat(s, '}') ELSE concat(split_part(s, '}', 1), '}') END AS repaired
    FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN replace(props, '}', '') WHEN 1 THEN concat(props, ' and {more}') ELSE props END AS s FROM events)""")
def p12_json_repaired(get):
    s = F.when(C("event_id") % 3 == 0, F.replace("props", F.lit("}"), F.lit(""))).when(C("event_id") % 3 == 1, F.concat("props", F.lit(" and {more}"))).otherwise(C("props"))
    return get("events").select("event_id", t.repair_json(s).alias("repaired"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE event_id % 4 <> 0")
def p13_literal_parsed(get):
    """Single-quoted objects parse, and what does not parse is dropped, never evaluated."""
    s = F.when(C("event_id") % 4 == 0, F.lit("no object")).otherwise(F.translate("props", '"', "'"))
    return get("events").select("event_id", F.from_json(s, "k long", {"allowSingleQuotes": "true", "mode": "PERMISSIVE"})["k"].alias("k")).where("k is not null")


@query("SELECT row_id, row_id // 100 AS group_id, row_id % 100 AS idx FROM {instr}")
def p16_group_and_index(get):
    return get("instr").select("row_id", F.floor(C("row_id") / 100).alias("group_id"), (C("row_id") % 100).alias("idx"))


@query(r"SELECT row_id, regexp_replace(concat(edit, ' (', size, ' words)'), '\s*\([^)]*\)$', '') AS edit FROM {instr}")
def p18_trailing_count_stripped(get):
    return get("instr").select("row_id", t.drop_trailing_parens(F.concat("edit", F.lit(" ("), C("size").cast("string"), F.lit(" words)"))).alias("edit"))


@query(r"SELECT row_id, regexp_replace(input, '\.$', '') || ', realistic photo, best quality' AS prompt FROM {instr}")
def p20_prompt_suffix(get):
    return get("instr").select("row_id", F.concat(F.regexp_replace("input", r"\.$", ""), F.lit(", realistic photo, best quality")).alias("prompt"))


@query("SELECT row_id, CASE WHEN ends_with(lower(trim(edit)), '.') THEN lower(trim(edit)) ELSE concat(lower(trim(edit)), '.') END AS caption FROM {instr}")
def p24_caption(get):
    return get("instr").select("row_id", t.caption(C("edit")).alias("caption"))


@query("SELECT row_id, CASE WHEN list_contains(string_split(image_file, '/'), 'run_1') THEN concat('one_', row_id) ELSE concat('other_', row_id) END AS target FROM {instr}")
def p26_prefix_by_path(get):
    one = F.array_contains(F.split("image_file", "/"), "run_1")
    return get("instr").select("row_id", F.concat(F.when(one, "one_").otherwise("other_"), C("row_id").cast("string")).alias("target"))


# --------------------------------------------------------------------------- filters


_WORDS = "string_split(trim(replace(input, ',', ''), '.'), ' ')"
_GUARD = f"""CASE edit_type WHEN 'background_change' THEN new_background IS NOT NULL
    WHEN 'appearance_alter' THEN edited_object IS NOT NULL AND list_contains({_WORDS}, string_split(edited_object, ' ')[-1]) AND NOT list_contains(string_split(edit, ' '), 'color')
    WHEN 'remove' THEN edited_object IS NOT NULL WHEN 'replace' THEN edited_object IS NOT NULL ELSE true END"""


@query(f"SELECT row_id FROM {{instr}} WHERE coalesce({_GUARD}, false)")
def f_pre_guard(get):
    return get("instr").where(r.passes(r.pre_guard())).select("row_id")


@query(f"""SELECT row_id FROM {{instr}} JOIN {{scores}} USING (row_id) WHERE coalesce({_GUARD}, false) AND clip > 0.1 AND price / 300 > 2 AND greatest(size, 20) / least(size, 20) <= 2
    AND CASE WHEN edit_type IN ('remove', 'replace', 'appearance_alter', 'color_alter') THEN l1 < 0.95 ELSE true END""")
def f_generic_filter(get):
    rows = get("instr").join(get("scores"), "row_id")
    return rows.where(r.generic_filter(C("clip"), C("price") / 300, C("l1"), C("size"), F.lit(20))).select("row_id")


@query(f"SELECT row_id FROM {{instr}} WHERE NOT ({_any('split_part(edit, ' + chr(39) + 'to ' + chr(39) + ', -1)', r.PEOPLE)} OR {_any('split_part(edit, ' + chr(39) + 'into ' + chr(39) + ', -1)', r.PEOPLE)} OR {_any('edit', r.SIZES)})")
def f08_appearance_words(get):
    return get("instr").where(r.appearance_words()).select("row_id")


@query("SELECT row_id FROM {instr} WHERE NOT (list_contains(string_split(trim(output, '.'), ' '), string_split(new_background, ' ')[-1]) OR list_contains(string_split(trim(input, '.'), ' '), string_split(new_background, ' ')[-1]))")
def f11_background_words(get):
    return get("instr").where(r.passes(r.background_words(C("output")))).select("row_id")


@query(f"""SELECT row_id, array_to_string(fg, '|') AS foreground FROM (SELECT row_id, list_filter(string_split(input, ' '), lambda n: NOT list_contains(list_concat(string_split(trim(output, '.'), ' '), {_list(r.ROOMS)}), n)) AS fg
    FROM {{instr}} WHERE input IS NOT NULL AND output IS NOT NULL) WHERE len(fg) > 0""")
def f12_foreground(get):
    rows = get("instr").where("input is not null and output is not null").withColumn("fg", r.foreground(F.split("input", " "), C("output")))
    return rows.where(F.size("fg") > 0).select("row_id", F.array_join("fg", "|").alias("foreground"))


@query("SELECT row_id FROM {instr} WHERE input IS NOT NULL AND output IS NOT NULL AND edit IS NOT NULL AND input <> output")
def f14_complete(get):
    return get("instr").where(r.complete()).select("row_id")


@query("SELECT row_id, contains(lower(vqa_answer), 'yes') AS says_yes, list_has_any(string_split(vqa_answer, ' '), ['yes', 'true', 'right', 'correct']) AS affirmative FROM {scores}")
def f15_f38_answers(get):
    return get("scores").select("row_id", r.says_yes(C("vqa_answer")).alias("says_yes"), r.affirmative(C("vqa_answer")).alias("affirmative"))


@query(f"SELECT row_id FROM {{instr}} WHERE NOT {_any('edit', r.CHECKED_COLORS)}")
def f16_names_no_color(get):
    return get("instr").where(r.names_no_color()).select("row_id")


@query("SELECT row_id, regexp_extract_all(edit, '''(.*?)''', 1)[1] AS first_text, len(regexp_extract_all(edit, '''(.*?)''', 1)) AS texts FROM {instr}")
def f17_quoted_texts(get):
    q = t.quoted(C("edit"))
    return get("instr").select("row_id", F.get(q, F.lit(0)).alias("first_text"), F.size(q).alias("texts"))


@query("SELECT p_partkey, p_name FROM part WHERE NOT regexp_matches(concat(p_name, ' ', p_size), '(?i)note|please|[0-9].|\\*')")
def f21_concept_junk(get):
    return get("part").where(~F.concat("p_name", F.lit(" "), C("p_size").cast("string")).rlike(r"(?i)note|please|[0-9].|\*")).select("p_partkey", "p_name")


_NAMED = "edited_object IS NOT NULL AND contains(edit, edited_object) AND NOT contains(edit, 'background')"
_TRIED = f"coalesce(CASE WHEN edit_type IN ('add', 'remove', 'counting') THEN {_NAMED} WHEN edit_type = 'replace' THEN {_NAMED} AND new_object IS NOT NULL WHEN edit_type = 'background_change' THEN new_background IS NOT NULL ELSE true END, false)"


@query(f"SELECT row_id FROM {{instr}} WHERE {_TRIED}")
def f23_driver_guard(get):
    return get("instr").where(r.passes(r.driver_guard())).select("row_id")


@query("SELECT row_id FROM {instr} JOIN {scores} USING (row_id) WHERE edited_object NOT IN ('people', 'man', 'woman', 'boy', 'girl', 'person') AND new_object NOT IN ('people', 'man', 'woman', 'boy', 'girl', 'person') AND l1 BETWEEN 0.05 AND 0.95")
def f26_replace_share(get):
    return get("instr").join(get("scores"), "row_id").where(r.replace_share(C("l1"))).select("row_id")


@query(r"SELECT row_id, regexp_matches(image_file, '_[12]') AS anywhere, regexp_matches(image_file, '_[12]\.\w+$') AS at_end FROM {instr}")
def f28_variant_paths(get):
    return get("instr").select("row_id", r.variant_path(C("image_file"), True).alias("anywhere"), r.variant_path(C("image_file")).alias("at_end"))


_POST = """coalesce(CASE edit_type WHEN 'add' THEN clip > 0.2 AND detected WHEN 'replace' THEN clip > 0.2 AND clip_dir > 0.08 AND detected_new WHEN 'remove' THEN clip > 0.15 AND NOT detected
    WHEN 'action_change' THEN clip > 0.3 AND clip_dir > 0.05 WHEN 'appearance_alter' THEN clip > 0.25 AND l1 > 0.3 AND clip_dir > 0.06 WHEN 'tone_transfer' THEN clip > 0.25 AND l1 > 0.2 AND l1 < 0.8
    WHEN 'background_change' THEN clip > 0.15 AND vqa AND l1 > 0.2 AND l1 < 0.9 WHEN 'color_alter' THEN clip > 0.2 AND l1 > 0.3 AND vqa
    WHEN 'textual' THEN len(q) = 2 AND contains(ocr_src, q[1]) AND contains(ocr_dst, q[2]) END, false)"""
_SCORED = "(SELECT i.*, s.* EXCLUDE (row_id), list_has_any(string_split(vqa_answer, ' '), ['yes', 'true', 'right', 'correct']) AS vqa, regexp_extract_all(edit, '''(.*?)''', 1) AS q FROM {instr} i JOIN {scores} s USING (row_id))"


def scored(get):
    names = ("clip", "clip_dir", "l1", "detected", "detected_new", "ocr_src", "ocr_dst")
    return r.selected(get("instr").join(get("scores"), "row_id"), {n: C(n) for n in names} | {"vqa": r.affirmative(C("vqa_answer"))})


@query(f"SELECT row_id, edit_type, {_POST} AS selected FROM {_SCORED}")
def f29_f37_post_thresholds(get):
    return scored(get).select("row_id", "edit_type", "selected")


@query(f"SELECT edit_type, count(*) FILTER ({_POST}) AS selected, count(*) AS total FROM {_SCORED} GROUP BY edit_type")
def a09_selected_by_type(get):
    return scored(get).groupBy("edit_type").agg(F.count_if("selected").alias("selected"), F.count("*").alias("total"))


@query(f"""SELECT edit_type, CASE WHEN NOT ({_TRIED}) THEN 'skipped' WHEN row_id % 23 = 0 THEN 'error' WHEN {_POST} THEN 'success' ELSE 'failure' END AS verdict, count(*) AS n FROM {_SCORED} GROUP BY ALL""")
def k03_verdicts(get):
    v = r.verdict(r.driver_guard(), C("selected"), C("row_id") % 23 == 0)
    return scored(get).groupBy("edit_type", v.alias("verdict")).agg(F.count("*").alias("n"))


# --------------------------------------------------------------------------- draws


@query("SELECT row_id, ['add', 'remove', 'replace'][1 + ('0x' || substr(md5('type|' || row_id), 1, 8))::BIGINT % 3] AS edit_type FROM {instr}")
def d01_uniform_choice(get):
    return get("instr").select("row_id", sm.pick(F.array(*map(F.lit, ("add", "remove", "replace"))), C("row_id"), "type").alias("edit_type"))


@query("SELECT row_id, array_to_string(list_transform(list_sort(list_transform(['a', 'b', 'c', 'd', 'e'], lambda x: md5('pick|' || row_id || '|' || x) || x))[1:3], lambda x: right(x, 1)), '') AS picked FROM {instr}")
def d03_sample_without_replacement(get):
    return get("instr").select("row_id", F.array_join(sm.sample(F.array(*map(F.lit, "abcde")), 3, C("row_id"), "pick"), "").alias("picked"))


_R = "('0x' || substr(md5('drop|' || row_id), 1, 8))::BIGINT / 4294967296.0"


@query(f"SELECT row_id, {_R} < 0.1 AS no_text, {_R} >= 0.05 AND {_R} < 0.15 AS no_image FROM {{instr}}")
def d07_condition_dropout(get):
    u, q = sm.unit(C("row_id"), "drop"), 0.05
    return get("instr").select("row_id", (u < 2 * q).alias("no_text"), ((u >= q) & (u < 3 * q)).alias("no_image"))


@query("SELECT CAST(('0x' || substr(md5('shard|' || row_id), 1, 8))::BIGINT % 8 AS INT) AS shard, count(*) AS n FROM {instr} GROUP BY 1")
def d08_u10_shards(get):
    from curatrix.operators.relational import shard

    return shard(get("instr"), "row_id", 8).groupBy("shard").agg(F.count("*").alias("n"))
