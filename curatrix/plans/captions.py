"""Queries over captions: counting, actions, places, layouts, concepts and prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from curatrix.functions import chat
from curatrix.functions import text as t
from curatrix.operators import keywords
from curatrix.operators import relational as rel
from curatrix.operators import rules as r
from curatrix.plans.base import query

C = F.col

#: The lexicon of the captions: a table of their words, with a lemma and a part of speech by rule.
_SAID_WORDS = "concat_ws(' ', input, output, edit, new_object)"
_LEXICON = f"""(SELECT word, regexp_replace(word, '(ning|ping|ting|ing|s)$', '') AS lemma, CASE ('0x' || substr(md5(word), 1, 8))::BIGINT % 5 WHEN 0 THEN 'ADJ' WHEN 1 THEN 'NOUN' WHEN 2 THEN 'NOUN' ELSE 'VERB' END AS pos
    FROM (SELECT DISTINCT unnest(string_split(regexp_replace({_SAID_WORDS}, '[.,]', '', 'g'), ' ')) AS word FROM {{acts}}))"""


def _lexicon(get):
    word = get.spread("acts").select(F.explode_outer(F.split(F.regexp_replace(F.concat_ws(" ", "input", "output", "edit", "new_object"), "[.,]", ""), " ")).alias("word")).distinct()
    h = F.conv(F.substring(F.md5("word"), 1, 8), 16, 10).cast("long") % 5
    return word.select("word", F.regexp_replace("word", "(ning|ping|ting|ing|s)$", "").alias("lemma"), F.when(h == 0, "ADJ").when(h <= 2, "NOUN").otherwise("VERB").alias("pos"))


def _entries(value: str, where: str = "true") -> str:
    return f"(SELECT map_from_entries(list({{'k': word, 'v': {value}}})) FROM {_LEXICON} WHERE {where})"


TEMPLATES = {"add": "Add a thing", "remove": "Remove a thing", "replace": "Replace a thing"}


def _map(words: dict[str, str]):
    return F.create_map(*[F.lit(x) for kv in words.items() for x in kv])


def _sql_map(words: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in words.items()) + "}"


def _sql_list(words: list[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _draw(seed: str) -> str:
    return f"('0x' || substr(md5('{seed}|' || row_id), 1, 8))::BIGINT"


_N, _D = _sql_list(r.NUMBER_WORDS), _sql_list([str(i) for i in range(10)])


@query(f"""WITH f AS (SELECT row_id, caption, list_filter(list_transform([noun, 'chairs'], lambda n: {{'noun': n, 'said': string_split(trim(split_part(caption, n, 1)), ' ')[-1]}}),
        lambda x: greatest(coalesce(list_position({_D}, x.said), 0), coalesce(list_position({_N}, x.said), 0)) > 2)[1] AS x FROM {{acts}}),
    n AS (SELECT row_id, caption, x.noun AS noun, greatest(coalesce(list_position({_D}, x.said), 0), coalesce(list_position({_N}, x.said), 0)) - 1 AS n FROM f WHERE x IS NOT NULL),
    g AS (SELECT *, CAST({_draw('gone')} % n + 1 AS INT) AS removed, {_sql_list(r.REMOVE_VERBS)}[1 + {_draw('remove')} % 3] AS verb, {_sql_list(r.LEFT_VERBS)}[1 + {_draw('left')} % 3] AS turn FROM n),
    w AS (SELECT *, {_N}[1 + n - removed] AS l, {_N}[1 + n] AS now, {_N}[1 + removed] AS gone FROM g)
    SELECT row_id, noun, removed, CASE {_draw('counting')} % 3 WHEN 0 THEN concat(verb, ' ', gone, ' of the ', noun, ' in the image') WHEN 1 THEN concat(turn, ' the total number of the ', noun, ' from ', now, ' to ', l)
        ELSE concat(verb, ' ', gone, ' of the ', noun, ' to ', lower(turn), ' the total number from ', now, ' to ', l) END AS edit, replace(caption, concat(' ', now, ' ', noun), concat(' ', l, ' ', noun)) AS output FROM w""")
def p08_f45_counted(get):
    """Captions in which a number stands before a noun, with an edit that takes some away."""
    rows = get("acts").withColumn("found", r.counted_noun(C("caption"), F.array("noun", F.lit("chairs")))).where("found is not null")
    edit, output, gone = r.counted(C("caption"), C("found"), C("row_id"))
    return rows.select("row_id", "found.noun", gone.alias("removed"), edit.alias("edit"), output.alias("output"))


@query(f"SELECT p_partkey, CASE WHEN p_size < 10 THEN {_N}[1 + p_size] ELSE p_size::VARCHAR END AS said, list_position({_N}, {_N}[1 + p_size % 10])::INT - 1 AS again FROM part")
def f17_number_words(get):
    names = F.array(*map(F.lit, r.NUMBER_WORDS))
    return get("part").select("p_partkey", F.coalesce(F.get(names, C("p_size")), C("p_size").cast("string")).alias("said"), (F.array_position(names, F.get(names, C("p_size") % 10)) - 1).cast("int").alias("again"))


@query(f"""WITH t AS (SELECT row_id, {_entries('lemma', "pos = 'VERB'")} AS m, string_split(input, ', ') AS i, string_split(output, ', ') AS o, string_split(split_part(edit, 'to ', -1), ' ')[1] AS new FROM {{acts}}),
    n AS (SELECT *, least(len(i), len(o)) AS k, coalesce(m[new], new) AS lem FROM t),
    h AS (SELECT *, coalesce(list_position(list_transform(o[1:k], lambda c: len(list_filter(string_split(trim(c, '.'), ' '), lambda w: coalesce(m[w], w) = lem)) > 0), true), 0) AS hit FROM n),
    v AS (SELECT *, CASE WHEN hit > 0 THEN list_transform(list_filter(string_split(trim(i[hit], '.'), ' '), lambda w: m[w] IS NOT NULL), lambda w: m[w]) ELSE [] END AS verbs, CASE WHEN hit > 0 THEN hit ELSE k END AS z FROM h)
    SELECT row_id, new NOT IN ('be', 'being', 'have', 'having') AND NOT (hit > 0 AND (len(verbs) = 0 OR list_contains(verbs, lem) OR list_contains(verbs, new))) AS kept,
        array_to_string(i[1:z], ', ') AS input, array_to_string(o[1:z], ', ') AS output FROM v""")
def f10_p21_action_cut(get):
    """Verbs by a lexicon, of which each row gets its own words."""
    kept, said, output = r.action_cut(C("edit"), C("input"), C("output"), C("verbs"))
    words = F.split(F.regexp_replace(F.concat_ws(" ", "input", "output", "edit"), "[.,]", ""), " ")
    return keywords.with_lexicon(get.spread("acts"), "row_id", words, _lexicon(get).where("pos = 'VERB'"), "lemma", "verbs").select("row_id", kept.alias("kept"), said.alias("input"), output.alias("output"))


@query(f"""WITH w AS (SELECT row_id, {_entries('lemma')} AS m, string_split(new_object, ' ')[-1] AS w FROM {{acts}}), l AS (SELECT row_id, unnest([w, coalesce(m[w], w)]) AS w FROM w)
    SELECT row_id FROM l GROUP BY 1 HAVING count(*) FILTER (w IN ({_sql_list(r.PEOPLE_REPLACED)[1:-1]}) OR regexp_matches(w, '(er|or|ist|ian|ee)$')) = 0""")
def f09_replace_words(get):
    """Objects whose last word, and its lemma, name no human."""
    last = t.last_word(C("new_object"))
    rows = keywords.with_lexicon(get.spread("acts"), "row_id", F.array(last), _lexicon(get), "lemma", "lemmas")
    return rows.where(r.passes(r.replace_words(C("lemmas")[last]))).select("row_id")


@query(f"""SELECT row_id FROM (SELECT row_id, edit_type, {_entries('pos')} AS m, string_split(trim(input, '.'), ' ') AS w FROM {{acts}})
    WHERE len(list_filter(w, lambda x: coalesce(m[x], '') = CASE WHEN edit_type = 'action_change' THEN 'VERB' ELSE 'NOUN' END)) > 0""")
def f13_nouns_and_verbs(get):
    rows = keywords.with_lexicon(get.spread("acts"), "row_id", t.words(t.strip(C("input"), ".")), _lexicon(get), "pos", "tags")
    return rows.where(r.named_parts(C("edit_type"), C("input"), C("tags"))).select("row_id")


_TAGGED = """(SELECT word, CASE h % 4 WHEN 0 THEN 'VERB' WHEN 1 THEN 'PROPN' ELSE 'NOUN' END AS pos, CASE WHEN h % 5 = 0 THEN 'PERSON' END AS entity, regexp_replace(word, 's$', '') AS lemma
    FROM (SELECT DISTINCT word, ('0x' || substr(md5(word), 1, 8))::BIGINT AS h FROM (SELECT unnest(string_split(text, ' ')) AS word FROM documents)))"""


@query(f"""SELECT DISTINCT lower(lemma) AS concept FROM {_TAGGED} WHERE pos IN ('NOUN', 'PROPN') AND coalesce(entity, '') <> 'PERSON'
    AND lower(word) IN (SELECT lower(w) FROM (SELECT unnest(string_split(text, ' ')) AS w FROM conversations))""")
def f19_noun_concepts(get):
    """Words of documents that are nouns by a table of tags, no persons, and in the vocabulary of the conversations."""
    words = lambda name: get(name).select(F.explode(F.split("text", " ")).alias("word")).distinct()
    h = F.conv(F.substring(F.md5("word"), 1, 8), 16, 10).cast("long")
    pos = F.when(h % 4 == 0, "VERB").when(h % 4 == 1, "PROPN").otherwise("NOUN")
    tags = words("documents").select("word", pos.alias("pos"), F.when(h % 5 == 0, "PERSON").alias("entity"), F.regexp_replace("word", "s$", "").alias("lemma"))
    return r.noun_concepts(words("documents"), tags, words("conversations"))


@query(r"SELECT DISTINCT regexp_replace(word, '[^\x00-\x7F]', '', 'g') AS word FROM (SELECT unnest(string_split(text, ' ')) AS word FROM documents) WHERE NOT regexp_matches(word, '[0-9]')")
def f20_plain_words(get):
    w = get("documents").select(F.explode(F.split("text", " ")).alias("word")).distinct()
    return w.where(~C("word").rlike("[0-9]")).select(t.ascii_only(C("word")).alias("word")).distinct()


@query("""WITH l AS (SELECT conv_id AS concept, string_split(CASE WHEN role = 'system' THEN NULL ELSE text END, ' ') AS ws FROM conversations)
    SELECT concept, len(list_distinct(flatten(list(ws)))) AS n FROM l WHERE ws IS NOT NULL AND len(ws) > 1 GROUP BY 1 HAVING len(list_distinct(flatten(list(ws)))) >= 5""")
def f22_usable_sets(get):
    """Concepts whose lists, nulls and lists of one aside, hold at least five different words."""
    rows = get("conversations").select(C("conv_id").alias("concept"), F.split(F.when(C("role") != "system", C("text")), " ").alias("ws")).where("ws is not null and size(ws) > 1")
    return rows.select("concept", F.explode("ws").alias("w")).distinct().groupBy("concept").agg(F.count("*").alias("n")).where("n >= 5")


@query("""WITH s AS (SELECT row_id, edit, contains(right(edit, 20), 'on the') OR contains(right(edit, 20), 'in the') OR contains(right(edit, 20), 'at the') AS placed, ('0x' || substr(md5('place|' || row_id), 1, 8))::BIGINT AS h FROM {instr}),
    b AS (SELECT row_id, edit, unnest(range(10)) AS i, h FROM s WHERE NOT placed)
    SELECT row_id, edit FROM s WHERE placed UNION ALL SELECT row_id, concat(trim(edit, '.'), ' near ', lower(n_name), '.') FROM b JOIN nation ON n_nationkey = (h + i) % (SELECT count(*) FROM nation)""")
def p19_location_fallback(get):
    backgrounds = get("nation").select(C("n_nationkey").cast("long").alias("pos"), F.concat(F.lit("near "), F.lower("n_name")).alias("background"))
    return r.located(get("instr").select("row_id", "edit"), "edit", "row_id", backgrounds)


@query("""WITH a AS (SELECT doc_id, text, len(string_split(text, ' ')) AS n FROM documents), b AS (SELECT doc_id, CASE WHEN n > 77 THEN concat(split_part(text, '. ', 1), '.') ELSE text END AS s FROM a),
    c AS (SELECT doc_id, CASE WHEN len(string_split(s, ' ')) > 77 THEN concat(split_part(s, ', ', 1), '.') ELSE s END AS s FROM b)
    SELECT doc_id, CASE WHEN len(string_split(s, ' ')) > 77 THEN array_to_string(string_split(s, ' ')[1:77], ' ') ELSE s END AS caption FROM c""")
def p23_caption_shortened(get):
    """Texts cut to 77 words by sentence, by clause, by word."""
    return get("documents").select("doc_id", t.shorten(C("text"), lambda s: F.size(t.words(s))).alias("caption"))


_SEP = "concat(chr(10), chr(10), '#')"


@query(f"""WITH h AS (SELECT row_id, concat(array_to_string(string_split(layout, {_SEP})[1:3], {_SEP}), chr(10), '```') AS head FROM {{acts}}),
    v AS (SELECT row_id, head, unnest(CASE WHEN contains(head, 'location=''in the center''') THEN {_sql_list(r.LAYOUTS)} ELSE ['ori'] END) AS relation FROM h)
    SELECT row_id, relation, CASE WHEN relation = 'ori' THEN head ELSE replace(head, 'location=''in the center''', concat('location=''in the ', relation, '''')) END AS layout FROM v""")
def p27_layout_variants(get):
    return get("acts").select("row_id", F.explode(r.layouts(C("layout"))).alias("v")).select("row_id", "v.relation", "v.layout")


@query(f"""WITH e AS (SELECT edit_type, string_agg(edit, ' / ' ORDER BY h) AS shots FROM (SELECT edit_type, edit, md5('shot|' || row_id) AS h, row_number() OVER (PARTITION BY edit_type ORDER BY md5('shot|' || row_id)) AS k FROM {{instr}}) WHERE k <= 5 GROUP BY 1)
    SELECT row_id, concat(coalesce({_sql_map(TEMPLATES)}[edit_type], 'Edit the picture'), ': ', shots, ' / ', input) AS prompt FROM {{instr}} JOIN e USING (edit_type) WHERE input IS NOT NULL""")
def p11_d05_prompts(get):
    """Few-shot prompts by the template of the type, with five examples by draw: a table of as many rows as types."""
    rows = get("instr")
    h = F.md5(F.concat(F.lit("shot|"), C("row_id").cast("string")))
    shots = rel.first_k(rows.select("edit_type", F.struct(h.alias("h"), "edit").alias("s")), "edit_type", "s", 5)
    shots = shots.select("edit_type", F.array_join(F.transform("s", lambda s: s["edit"]), " / ").alias("shots"))
    head = F.coalesce(_map(TEMPLATES)[C("edit_type")], F.lit("Edit the picture"))
    return rows.where("input is not null").join(shots, "edit_type").select("row_id", F.concat(head, F.lit(": "), "shots", F.lit(" / "), "input").alias("prompt"))


_SEPS = {"single": ("###", ""), "two": (" ", "</s>"), "mpt": ("<|im_end|>", ""), "plain": ("\n", "\n\n"), "llama_2": ("<s>", "</s>"), "mistral": ("", "</s>"), "llama_3": ("<|end|>", "")}
_SAID = {
    "single": "'Be brief.' || '###' || string_agg(CASE WHEN text = '' THEN role || ':' ELSE role || ': ' || text || '###' END, '' ORDER BY i)",
    "two": "'Be brief.' || ' ' || string_agg(CASE WHEN text = '' THEN role || ':' ELSE role || ': ' || text || CASE WHEN i % 2 = 1 THEN '</s>' ELSE ' ' END END, '' ORDER BY i)",
    "mpt": "'Be brief.' || '<|im_end|>' || string_agg(CASE WHEN text = '' THEN role ELSE role || text || '<|im_end|>' END, '' ORDER BY i)",
    "plain": "'Be brief.' || string_agg(CASE WHEN text = '' THEN '' ELSE text || CASE WHEN i % 2 = 1 THEN repeat(chr(10), 2) ELSE chr(10) END END, '' ORDER BY i)",
    "llama_2": "ltrim(string_agg(CASE WHEN text = '' THEN '' WHEN i % 2 = 1 THEN ' ' || text || ' </s>' ELSE '<s>[INST] ' || CASE WHEN i = 0 THEN '<<SYS>>' || chr(10) || 'Be brief.' || chr(10) || '<</SYS>>' || repeat(chr(10), 2) ELSE '' END || text || ' [/INST]' END, '' ORDER BY i), '<s>')",
    "mistral": "'<s>' || string_agg(CASE WHEN text = '' THEN '' WHEN i % 2 = 1 THEN text || '</s>' ELSE '[INST] ' || CASE WHEN i = 0 THEN 'Be brief.' || chr(10) ELSE '' END || text || ' [/INST]' END, '' ORDER BY i)",
    "llama_3": "'Be brief.' || '<|end|>' || string_agg(CASE WHEN text = '' THEN role ELSE role || text || '<|end|>' END, '' ORDER BY i)",
}
_TURNS = "(SELECT conv_id, role, CASE WHEN turn % 7 = 6 THEN '' ELSE text END AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations)"


@query("SELECT conv_id, " + ", ".join(f"{v} AS {k}" for k, v in _SAID.items()) + f" FROM {_TURNS} GROUP BY conv_id")
def f22_chat_rendering(get):
    """Each conversation in the seven styles; a conversation is one row, as a prompt must be."""
    said = F.array_sort(F.collect_list(F.struct("turn", "role", F.when(C("turn") % 7 == 6, "").otherwise(C("text")).alias("text"))))
    rows = get("conversations").groupBy("conv_id").agg(said.alias("turns"))
    return rows.select("conv_id", *[chat.prompt(k, F.lit("Be brief."), C("turns"), *_SEPS[k]).alias(k) for k in chat.STYLES])
