"""Profile, lexical, diagnostic, source and event queries.

A conversation is a group and its turns are the captions; `benchmark` items are lexical queries
against `documents`; `events` are the request log.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicons
from ..functions import text as T
from ..operators import diagnostics, lexical, profile
from ..sources import records
from ..streaming import events as streams

Q: dict = {}
K = 10


def query(sql=None):
    def add(f):
        Q[f.__name__] = (f, sql)
        return f

    return add


def table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


# captions that the conversations lack: words of every lexicon, repeats within and across groups, a blank one, marks
PLANTED_CAPTIONS = [
    (1_000_001, 0, "Two red dogs and a dog run on 3 boats."),
    (1_000_001, 1, "A man is standing next to a horse"),
    (1_000_001, 2, "a man is  standing next to a horse "),
    (1_000_002, 0, "A man is standing next to a horse"),
    (1_000_002, 1, " "),
    (1_000_003, 0, "(see [box] at 5 % {here}!)"),
    (1_000_003, 1, "xx xylophone, the cat's car"),
    (1_000_004, 0, "without a dog or cat in the big kitchen the boy eats seven pizzas near twelve people on a bench"),
    *[(1_000_010 + i, 0, "the same text in many groups") for i in range(12)],
]


def captions(spark, sf):
    planted = spark.createDataFrame([(g, t, x, "user") for g, t, x in PLANTED_CAPTIONS], "conv_id long, turn long, text string, role string")
    every = table(spark, sf, "conversations").select("conv_id", "turn", "text", "role").union(planted)
    return every.select(F.concat_ws("#", "conv_id", "turn").alias("caption_id"), F.col("conv_id").alias("group_id"), "text", "role")


def groups(spark, sf):
    return captions(spark, sf).select("group_id").distinct()


FOLD = lambda x: f"replace(lower({x}), 'ß', 'ss')"
WORD = T.WORD.replace("'", "''")
WORDS = lambda x: f"regexp_extract_all({FOLD(x)}, '{WORD}')"
NORM = lambda x: f"trim(regexp_replace({FOLD(x)}, '\\s+', ' ', 'g'))"
_ROWS = ", ".join("({}, {}, '{}', 'user')".format(g, t, x.replace("'", "''")) for g, t, x in PLANTED_CAPTIONS)
C = f"c as (select conv_id::varchar || '#' || turn::varchar as caption_id, conv_id as group_id, coalesce(text, '') as text, role from (select conv_id, turn, text, role from conversations union all select * from (values {_ROWS}) v(conv_id, turn, text, role)))"
M = f"{C}, m as (select *, {WORDS('text')} as tokens, len({WORDS('text')}) as n, {NORM('text')} as norm from c)"
HASH = lambda x, seed=42: f"sha256('{seed}:' || {x}::varchar)"


def numbers_sql(x, name):
    return (
        f"count({x}) as {name}_count, min({x}) as {name}_min, max({x}) as {name}_max, round(avg({x}), 6) as {name}_mean, round(quantile_cont({x}, 0.5), 6) as {name}_median,"
        f" round(quantile_cont({x}, 0.1), 6) as {name}_p10, round(quantile_cont({x}, 0.9), 6) as {name}_p90"
    )


@query(f"with {M} select caption_id, norm, n::bigint as n_words from m")
def normalized_captions(spark, sf):
    return profile.measured(captions(spark, sf)).select("caption_id", "norm", "n_words")


@query(
    f"""with {M} select {numbers_sql('n', 'words')}, count(*) as captions, sum((trim(text) = '')::int)::bigint as empty, sum((n <= 1)::int)::bigint as near_empty, sum((n < 3)::int)::bigint as short,
 sum((n > 30)::int)::bigint as long, sum(regexp_matches(text, '[^\\x20-\\x7E]')::int)::bigint as unusual, sum(length(text) - length(regexp_replace(text, '\\p{{P}}', '', 'g')))::bigint as punctuation from m"""
)
def caption_statistics(spark, sf):
    return profile.caption_statistics(captions(spark, sf))


TOKENS = f"{M}, tk as (select unnest(tokens) as token from m), tf as (select token, count(*) as n from tk group by 1)"


@query(f"with {TOKENS} select * from tf")
def token_frequencies(spark, sf):
    return profile.token_frequencies(captions(spark, sf))


STOP = ", ".join(f"'{w}'" for w in profile.STOPWORDS)


@query(
    f"""with {TOKENS}, s as (select sum(n)::bigint as tokens, count(*) as vocabulary, sum((n = 1)::int)::bigint as hapaxes, sum(case when token in ({STOP}) then n else 0 end)::bigint as stopwords,
 sum(case when regexp_matches(token, '^[0-9]+$') then n else 0 end)::bigint as numeric from tf) select *, round(vocabulary / tokens, 6) as type_token_ratio, round(stopwords / tokens, 6) as stopword_share from s"""
)
def vocabulary_statistics(spark, sf):
    return profile.vocabulary_statistics(captions(spark, sf))


@query(f"with {TOKENS} select * from tf order by n desc, token limit 50")
def top_tokens(spark, sf):
    return profile.top_tokens(captions(spark, sf))


@query(f"with {TOKENS} select n, count(*) as tokens from tf group by 1")
def frequency_of_frequency(spark, sf):
    return profile.frequency_of_frequency(captions(spark, sf))


@query(f"with {M} select role, {numbers_sql('n', 'words')} from m group by 1")
def length_distribution(spark, sf):
    return profile.length_distribution(captions(spark, sf), "role")


@query(f"with {M} select case when n >= 40 then '40+' else n::varchar end as words, count(*) as captions from m group by 1")
def length_histogram_overflow(spark, sf):
    return profile.length_histogram(captions(spark, sf))


@query(f"with {M} select norm, count(*) as captions, count(distinct group_id) as groups, min(caption_id) as first_caption, count(distinct group_id) > 1 as cross_group from m where norm <> '' group by 1 having count(*) > 1")
def duplicate_caption_groups(spark, sf):
    return profile.duplicate_groups(captions(spark, sf))


SPLIT = f"""{C}, gr as (select distinct group_id from c), pl as (select group_id, row_number() over (order by {HASH('group_id')}) - 1 as place, count(*) over () as n from gr),
sz as (select *, greatest(1, floor(n * 0.8)) as nt, case when n >= 3 then greatest(1, floor(n * 0.1)) else floor(n * 0.1) end as nv from pl),
sp as (select group_id, case when place < nt then 'train' when place < nt + nv then 'validation' else 'test' end as split from sz)"""


def split(spark, sf):
    return profile.split_groups(groups(spark, sf))


def split_captions(spark, sf):
    return captions(spark, sf).join(split(spark, sf), "group_id")


@query(f"with {SPLIT} select * from sp")
def split_assignment(spark, sf):
    return split(spark, sf)


@query(f"with {SPLIT} select split, count(*) as groups from sp group by 1")
def split_counts(spark, sf):
    return split(spark, sf).groupBy("split").agg(F.count(F.lit(1)).alias("groups"))


@query(f"with {SPLIT}, x as (select c.*, {NORM('text')} as norm, split from c join sp using (group_id)) select norm, count(*) as captions, count(distinct group_id) as groups, min(caption_id) as first_caption, count(distinct split) as splits, count(distinct group_id) > 1 as cross_group, count(distinct split) > 1 as cross_split from x where norm <> '' group by 1 having count(*) > 1")
def cross_split_duplicates(spark, sf):
    return profile.duplicate_groups(split_captions(spark, sf))


@query(f"with {C}, gr as (select distinct group_id from c) select group_id from gr order by {HASH('group_id')}, group_id limit 20")
def tier_selection(spark, sf):
    return profile.tier(groups(spark, sf), 20)


@query(
    f"""with {SPLIT}, q as (select split, count(*) as ns, sum(count(*)) over () as n from sp group by 1), r as (select split, round_even(30.0 * ns / n, 0)::bigint as q from q),
f as (select split, case when split = 'train' then q + 30 - (select sum(q) from r) else q end as q from r), o as (select *, row_number() over (partition by split order by {HASH('group_id')}, group_id) as rn from sp)
select group_id, o.split from o join f on o.split = f.split where rn <= q"""
)
def stratified_tier(spark, sf):
    return profile.stratified_tier(split(spark, sf), 30)


@query(f"select doc_id from documents order by {HASH('doc_id', 7)}, doc_id limit 50")
def stable_sample(spark, sf):
    d = table(spark, sf, "documents").select("doc_id")
    return d.orderBy(profile.hash_order(F.col("doc_id"), 7), "doc_id").limit(50)


@query(
    f"""with {SPLIT}, x as (select group_id, {NORM('text')} as norm, split from c join sp using (group_id)) select 'group' as kind, 'CRITICAL' as severity, count(*) as n from (select group_id from x group by 1 having count(distinct split) > 1)
 union all select 'text', 'benign', count(*) from (select norm from x where norm <> '' group by 1 having count(distinct split) > 1)"""
)
def leakage_audit(spark, sf):
    return profile.leakage(split_captions(spark, sf))


@query(
    f"""with {C}, g as (select group_id::varchar as group_id, list({{'i': caption_id, 't': text, 'n': {NORM('text')}}}) as c from c group by 1)
select group_id, 'empty_text' as rule from g where len(list_filter(c, lambda x: trim(x.t) = '')) > 0 union all select group_id, 'duplicate_text' from g where len(list_distinct(list_transform(c, lambda x: x.n))) < len(c)
 union all select group_id, 'duplicate_caption_id' from g where len(list_distinct(list_transform(c, lambda x: x.i))) < len(c)"""
)
def manifest_validation_findings(spark, sf):
    c = captions(spark, sf).groupBy(F.col("group_id").cast("string").alias("group_id")).agg(F.collect_list(F.struct("caption_id", F.coalesce("text", F.lit("")).alias("text"))).alias("captions"))
    return profile.findings(c.withColumn("split", F.lit(None).cast("string")))


@query(f"with {SPLIT}, p as (select split, group_id, count(*) as n from c join sp using (group_id) group by 1, 2) select split, count(*) as groups, sum(n)::bigint as captions, min(n) as least, max(n) as most, round(avg(n), 6) as mean from p group by 1")
def dataset_statistics(spark, sf):
    return profile.dataset_statistics(split_captions(spark, sf))


@query(
    "select (select count(*) from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id)) as groups_without_captions, (select count(*) from labels l where not exists (select 1 from documents d where l.doc_id = d.doc_id)) as captions_without_group, (select count(*) from (select doc_id from labels group by 1 having count(*) > 1)) as repeated_caption_ids"
)
def structural_alignment(spark, sf):
    ids = lambda n: table(spark, sf, n).select(F.col("doc_id").alias("group_id"), F.col("doc_id").alias("caption_id"))
    return profile.alignment(ids("documents"), ids("labels"))


# lexical

D = "d as (select doc_id, coalesce(text, '') as text, source, lang from documents)"
B = "b as (select item_id as query_id, text from benchmark)"
TERMS = f"{D}, dt as (select doc_id, unnest({WORDS('text')}) as term from d), tf as (select doc_id, term, count(*) as tf from dt group by 1, 2)"
QTERMS = f"{B}, qt as (select query_id, unnest({WORDS('text')}) as term from b), qf as (select query_id, term, count(*) as tf from qt group by 1, 2)"


def docs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "text")


def asked(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), "text")


@query(f"with {TERMS} select * from tf")
def tokenize_terms(spark, sf):
    return lexical.terms(docs(spark, sf))


@query(f"with {C}, w as (select caption_id, {WORDS('text')} as t from c), g as (select caption_id, unnest(list_transform(generate_series(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1])) as gram from w) select caption_id, gram, count(*) as n from g group by 1, 2")
def ngrams_bigrams(spark, sf):
    c = captions(spark, sf).select("caption_id", F.explode(T.ngrams(T.words(F.coalesce("text", F.lit(""))), 2)).alias("gram"))
    return c.groupBy("caption_id", "gram").agg(F.count(F.lit(1)).alias("n"))


TFIDF = f"""{TERMS}, nn as (select count(*) as n from d), vo as (select term, count(*) as df, ln((1.0 + (select n from nn)) / (1.0 + count(*))) + 1 as idf from tf group by 1
 having count(*) >= 2 and count(*) <= greatest(1, floor(0.9 * (select n from nn)))), rw as (select doc_id, term, (1 + ln(tf)) * idf as w from tf join vo using (term)),
le as (select doc_id, sqrt(sum(w * w)) as l from rw group by 1), po as (select doc_id, term, w / l as weight from rw join le using (doc_id))"""


def _tfidf(spark, sf):
    return lexical.tfidf_index(docs(spark, sf), min_df=2, max_df=0.9)


@query(f"with {TFIDF} select doc_id, term, round(weight, 6) as weight from po")
def tfidf_vectors(spark, sf):
    return _tfidf(spark, sf)[0].select("doc_id", "term", F.round("weight", 6).alias("weight"))


TFSEARCH = f"""{TFIDF}, {QTERMS}, qw as (select query_id, term, (1 + ln(tf)) * idf as w from qf join vo using (term)), ql as (select query_id, sqrt(sum(w * w)) as l from qw group by 1),
sc as (select query_id, doc_id as candidate_id, round(sum(qw.w / ql.l * po.weight), 6) as score from qw join ql using (query_id) join po using (term) group by 1, 2),
tt as (select * from (select *, row_number() over (partition by query_id order by score desc, candidate_id) as rank from sc where score <> 0) where rank <= {K})"""


@query(f"with {TFSEARCH} select * from tt")
def tfidf_topk(spark, sf):
    return lexical.tfidf_search(_tfidf(spark, sf), asked(spark, sf), K)


BM = f"""{TERMS}, dl as (select doc_id, len({WORDS('text')}) as dl from d), co as (select count(*) as n, avg(dl) as avgdl from dl), fr as (select term, count(*) as df from tf group by 1)"""


@query(f"with {BM} select n, round(avgdl, 6) as avgdl, (select count(*) from fr) as features, (select count(*) from tf) as postings from co")
def bm25_stats(spark, sf):
    postings, frequency, constants = lexical.bm25_index(docs(spark, sf))
    f = frequency.agg(F.count(F.lit(1)).alias("features"), F.sum("df").alias("postings"))
    return constants.crossJoin(F.broadcast(f)).select("n", F.round("avgdl", 6).alias("avgdl"), "features", "postings")


BMSEARCH = f"""{BM}, {QTERMS}, sc as (select query_id, tf.doc_id as candidate_id, round(sum(ln(1 + (co.n - fr.df + 0.5) / (fr.df + 0.5)) * tf.tf * 2.5 / (tf.tf + 1.5 * (1 - 0.75 + 0.75 * dl.dl / co.avgdl))), 6) as score
 from (select distinct query_id, term from qf) q join fr using (term) join tf using (term) join dl on dl.doc_id = tf.doc_id, co group by 1, 2),
bt as (select * from (select *, row_number() over (partition by query_id order by score desc, candidate_id) as rank from sc where score <> 0) where rank <= {K})"""


@query(f"with {BMSEARCH} select * from bt")
def bm25_topk(spark, sf):
    return lexical.bm25_search(lexical.bm25_index(docs(spark, sf)), asked(spark, sf), K)


@query(f"with {BMSEARCH} select query_id, count(distinct source) as sources, max(n) as most_of_one from (select query_id, source, count(*) over (partition by query_id, source) as n from bt join d on bt.candidate_id = d.doc_id) group by 1")
def lexical_same_group_relevance(spark, sf):
    top = lexical.bm25_search(lexical.bm25_index(docs(spark, sf)), asked(spark, sf), K)
    source = table(spark, sf, "documents").select(F.col("doc_id").alias("candidate_id"), "source")
    per = top.join(source, "candidate_id").groupBy("query_id", "source").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("query_id").agg(F.count(F.lit(1)).alias("sources"), F.max("n").alias("most_of_one"))


@query(f"with {TERMS}, p as (select term, count(*) as df from tf group by 1) select (select count(distinct doc_id) from tf) as documents, count(*) as features, sum(strlen(term) + 16 * df)::bigint as bytes from p")
def index_statistics(spark, sf):
    return lexical.index_statistics(lexical.terms(docs(spark, sf))).select("documents", "features", "bytes")


# diagnostics

TX = lambda x: f"regexp_extract_all({FOLD(x)}, '[a-z0-9]+(?:''[a-z0-9]+)?')"
LIST = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
AMONG = lambda words: f"list_sort(list_distinct(list_filter(t, lambda w: list_contains({LIST(words)}, w))))"


def features_sql(captions):
    """CTEs over captions (caption_id, text) for the features ft."""
    return f"""x as (select caption_id, text, {TX('text')} as t from {captions}), ev as (select caption_id, unnest(t) as token from x), nv as (select token, count(*) as n from ev group by 1),
ra as (select caption_id, count(*) as r from ev join nv using (token) where n <= 1 group by 1),
fx as (select caption_id, len(t)::bigint as word_count, length(text)::bigint as character_count, len(list_distinct(t))::bigint as unique_token_count, coalesce(r, 0)::bigint as rare_token_count,
 round(coalesce(r, 0) / greatest(len(t), 1), 6) as rare_token_fraction,
 list_sort(list_distinct(list_filter(t, lambda w: regexp_full_match(w, '[0-9]+') or list_contains({LIST(lexicons.NUMBER_WORDS)}, w)))) as number_terms,
 {AMONG(lexicons.ATTRIBUTE_WORDS)} as attribute_terms, {AMONG(lexicons.ACTION_WORDS)} as action_terms, {AMONG(lexicons.SPATIAL_WORDS)} as spatial_terms, {AMONG(lexicons.OBJECT_WORDS)} as object_terms
 from x left join ra using (caption_id)),
ft as (select *, len(number_terms) > 0 as has_number_or_count_term, len(attribute_terms) > 0 as has_attribute_term, len(action_terms) > 0 as has_action_term, len(spatial_terms) > 0 as has_spatial_term,
 len(object_terms) > 0 as has_object_term, len(object_terms) >= 2 as multiple_object_terms, word_count <= 3 as short_caption, rare_token_count > 0 as rare_token_present from fx)"""


FEATURES = f"{C}, {features_sql('c')}"
TERM_LISTS = ["number_terms", "attribute_terms", "action_terms", "spatial_terms", "object_terms"]


@query(f"with {FEATURES} select * replace (" + ", ".join(f"array_to_string({t}, ' ') as {t}" for t in TERM_LISTS) + ") from ft")
def caption_features(spark, sf):
    return diagnostics.caption_features(captions(spark, sf)).withColumns({t: F.array_join(t, " ") for t in TERM_LISTS})


FLAGGED = [
    ("has_object_term", "object_confusion"),
    ("has_attribute_term", "attribute_confusion"),
    ("has_action_term", "action_confusion"),
    ("has_number_or_count_term", "counting_quantity"),
    ("has_spatial_term", "spatial_relation"),
    ("short_caption", "short_underspecified_query"),
    ("multiple_object_terms", "multiple_object_confusion"),
    ("rare_token_present", "lexical_ambiguity"),
]
CATEGORY = (
    " union all ".join(f"select caption_id, '{n}' as category, 'heuristic' as label_source from ft where {c}" for c, n in FLAGGED)
    + " union all select caption_id, 'other_unclassified', 'mechanical' from ft where not ("
    + " or ".join(c for c, _ in FLAGGED)
    + ")"
)


@query(f"with {FEATURES}, k as ({CATEGORY}) select category, label_source, count(*) as captions from k group by 1, 2")
def caption_categories(spark, sf):
    return diagnostics.categories(diagnostics.caption_features(captions(spark, sf))).groupBy("category", "label_source").agg(F.count(F.lit(1)).alias("captions"))


# every third conversation is the training part whose words are counted
STRATA = f"""{C}, x as (select caption_id, group_id, list_transform(regexp_extract_all(text, '[A-Za-z0-9]+(?:''[A-Za-z0-9]+)?'), lambda w: lower(w)) as t from c where trim(text) <> ''),
e as (select unnest(t) as token from x where group_id % 3 = 0), n as (select token, count(*) as n from e group by 1),
o as (select caption_id, t, list_filter(t, lambda w: not list_contains({LIST("a an and are at by for from has in is it of on or that the their this to with".split())}, w)) as k from x),
le as (select caption_id, min(coalesce(n, 0)) as rarest from (select caption_id, unnest(k) as token from o) left join n using (token) group by 1),
ob as (select caption_id, len(list_distinct(list_filter(k, lambda w: list_contains({LIST(lexicons.STRATA_OBJECTS)}, w))))::bigint as objects,
 list_has_any(k, ['one', 'two', 'three', 'four', 'five', 'six', 'seven', 'eight', 'nine', 'ten']) or list_contains(t, 'and') as more from o),
sr as (select caption_id, len(t)::bigint as words, case when len(t) <= 7 then 'short' when len(t) <= 14 then 'medium' else 'long' end as length, len(k)::bigint as content_words, rarest,
 case when rarest is null then 'unknown' when rarest <= 4 then 'rare' when rarest <= 49 then 'medium' else 'common' end as rarity, objects,
 case when objects >= 2 or (objects > 0 and more) then 'multi_object_or_structured' else 'single_object_or_simple' end as complexity from o left join le using (caption_id) join ob using (caption_id))"""


@query(f"with {STRATA} select * from sr")
def group_strata(spark, sf):
    c = captions(spark, sf)
    return diagnostics.caption_strata(c, c.filter("group_id % 3 = 0"))


@query(
    f"""with {C}, w as (select caption_id, group_id, {TX('text')} as t from c), p as (select a.group_id, len(list_intersect(list_distinct(a.t), list_distinct(b.t))) / greatest(1, len(list_distinct(list_concat(a.t, b.t)))) as j
 from w a join w b on a.group_id = b.group_id and a.caption_id < b.caption_id), h as (select group_id, avg(j) as j from p group by 1)
select group_id, count(*) as captions, min(len(t))::bigint as min_words, max(len(t))::bigint as max_words, round(avg(len(t)), 6) as mean_words, round(coalesce(any_value(j), 0), 6) as mean_jaccard from w left join h using (group_id) group by 1"""
)
def caption_set_features(spark, sf):
    return diagnostics.caption_set_features(captions(spark, sf))


@query(
    """with i as (select p_partkey as id, p_size as width, 25 as height from part) select id, case when width <= 0 then null when width / height <= 0.75 or width / height >= 4 / 3 then 'wide_or_tall_extreme'
 when width / height between 0.9 and 1.1 then 'near_square' else 'moderate_aspect' end as aspect from i"""
)
def aspect_strata(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), diagnostics.aspect_strata(F.col("p_size"), F.lit(25)).alias("aspect"))


def _corruption(name, change, sql):
    def run(spark, sf):
        c = captions(spark, sf).withColumn("text", F.coalesce("text", F.lit("")))
        return c.select("caption_id", change(F.col("text")).alias("text"))

    run.__name__ = name
    Q[name] = (run, None if sql is None else f"with {C} select caption_id, {sql} as text from c")


SW = "list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda w: w <> '')"
SEED = "('0x' || substr(sha256('5' || chr(0) || text), 1, 8))::bigint"


def _cut(n):
    first = f"(case when len({SW}) > 2 then 1 else 0 end)"
    return f"""case when len({SW}) <= 1 then text else array_to_string(list_filter({SW}, lambda w, i: i - 1 < {first} or
 ((i - 1 - {first} - ({SEED} % (len({SW}) - {first}))) % (len({SW}) - {first}) + len({SW}) - {first}) % (len({SW}) - {first}) >= least({n}, len({SW}) - {first})), ' ') end"""


LETTERS = "list_filter(generate_series(1, length(text) - 1), lambda i: regexp_full_match(substr(text, i, 2), '\\p{L}{2}'))"
SWAP = f"with p as (select caption_id, text, {SEED} as seed, {LETTERS} as p from c), a as (select *, p[seed % greatest(len(p), 1) + 1] as k, p[(seed // 17 + 1) % greatest(len(p), 1) + 1] as o from p), s as (select *, substr(text, 1, k - 1) || substr(text, k + 1, 1) || substr(text, k, 1) || substr(text, k + 2) as w from a)"


_corruption("text_corruption_casing_low", T.case_low, "regexp_extract(text, '^[^\\p{L}]*') || lower(substr(text, length(regexp_extract(text, '^[^\\p{L}]*')) + 1, 1)) || substr(text, length(regexp_extract(text, '^[^\\p{L}]*')) + 2)")
_corruption("text_corruption_casing", T.case_high, "upper(replace(text, 'ß', 'ss'))")
_corruption("text_corruption_punctuation_low", T.punctuation_low, "regexp_replace(rtrim(text), '[.,!?;:]+$', '')")
_corruption("text_corruption_punctuation", T.punctuation_high, "regexp_replace(text, '[^\\p{L}\\p{N}\\s]', ' ', 'g')")
_corruption("text_corruption_word_deletion_low", lambda x: T.delete_words(x, T.stable_seed(F.lit(5), x), None), _cut("1"))
_corruption("text_corruption_word_deletion", lambda x: T.delete_words(x, T.stable_seed(F.lit(5), x), 0.3), _cut(f"ceil(len({SW}) * 0.3::double)"))
_corruption("text_corruption_shortened_low", lambda x: T.shorten(x, 0.75), f"array_to_string({SW}[1:greatest(1, ceil(len({SW}) * 0.75))::bigint], ' ')")
_corruption("text_corruption_shortened", lambda x: T.shorten(x, 0.4), f"array_to_string({SW}[1:greatest(1, ceil(len({SW}) * 0.4::double))::bigint], ' ')")
_corruption("text_corruption_typo_low", lambda x: T.typo(x, T.stable_seed(F.lit(5), x)), None)
_corruption("text_corruption_typo", lambda x: T.typo(x, T.stable_seed(F.lit(5), x), high=True), None)
Q["text_corruption_typo_low"] = (Q["text_corruption_typo_low"][0], f"with {C}, q as ({SWAP} select caption_id, case when len(p) = 0 then text else w end as text from s) select * from q")
Q["text_corruption_typo"] = (
    Q["text_corruption_typo"][0],
    f"with {C}, q as ({SWAP} select caption_id, case when len(p) = 0 then text when len(p) = 1 or o = k or o = k + 1 then w else substr(w, 1, o - 1) || case when lower(substr(w, o, 1)) = 'x' then 'q' else 'x' end || substr(w, o + 1) end as text from s) select * from q",
)


PIECES = "regexp_extract_all(text, '[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\s]')"
TIDY = "trim(regexp_replace(regexp_replace(regexp_replace(array_to_string(list_filter(t, lambda z, k: k <> i), ' '), '\\s+([,.;!?%])', '\\1', 'g'), '([(\\[/{])\\s+', '\\1', 'g'), '\\s+([)\\]}])', '\\1', 'g'))"


@query(
    f"""with {C}, p as (select caption_id, {PIECES} as t from c), o as (select caption_id, t, unnest(generate_series(1, len(t))) as i from p),
j as (select caption_id, i, t[i] as token, {TIDY} as text from o)
select caption_id, (i - 1)::bigint as at, token, case when lower(token) in ('above', 'across', 'behind', 'below', 'beside', 'between', 'front', 'inside', 'near', 'next', 'on', 'over', 'under', 'with') then 'spatial_heuristic'
 when lower(token) in {tuple(lexicons.TOKEN_OBJECTS)} then 'object_heuristic' when lower(token) in {tuple(lexicons.TOKEN_ACTIONS)} then 'action_heuristic' when lower(token) in {tuple(lexicons.TOKEN_ATTRIBUTES)} then 'attribute_heuristic'
 when lower(token) in ('a', 'an', 'and', 'at', 'for', 'in', 'of', 'the', 'to') then 'stopword_like_heuristic' else 'other_token' end as category, case when text = '' then '[MASK]' else text end as text from j"""
)
def token_deletion_variants(spark, sf):
    return diagnostics.occlusions(captions(spark, sf))


@query(
    f"""with {C}, w as (select caption_id, group_id, list_distinct({TX('text')}) as w from c), p as (select a.group_id, case when len(list_distinct(list_concat(a.w, b.w))) = 0 then 0 else len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) end as j
 from w a join w b on a.group_id = b.group_id and a.caption_id < b.caption_id), g as (select group_id, count(*) as captions from c group by 1), h as (select group_id, avg(j) as j from p group by 1)
select group_id, captions, round(j, 6) as mean_jaccard from g left join h using (group_id)"""
)
def caption_pair_jaccard(spark, sf):
    return diagnostics.pairwise_jaccard(captions(spark, sf))


@query("with p as (select event_type as name, round(avg(value), 6) as quality, round(quantile_cont(value, 0.5), 6) as cost from events group by 1) select * from p a where not exists (select 1 from p b where b.quality >= a.quality and b.cost <= a.cost and (b.quality > a.quality or b.cost < a.cost))")
def pareto_frontier(spark, sf):
    e = table(spark, sf, "events").groupBy(F.col("event_type").alias("name")).agg(F.round(F.avg("value"), 6).alias("quality"), F.round(F.percentile("value", 0.5), 6).alias("cost"))
    return diagnostics.pareto(e).select("name", "quality", "cost")


@query("select count(*) as vectors, max(len(embedding))::bigint as dimension, (count(*) * max(len(embedding)) * 4)::bigint as bytes, round(count(*) * max(len(embedding)) * 4 / 1048576, 6) as mib from embeddings")
def storage_arithmetic(spark, sf):
    e = table(spark, sf, "embeddings").agg(F.count(F.lit(1)).alias("vectors"), F.max(F.size("embedding")).cast("long").alias("dimension"))
    size = F.col("vectors") * F.col("dimension") * 4
    return e.select("vectors", "dimension", size.alias("bytes"), F.round(size / 1048576, 6).alias("mib"))


@query("select event_type, count(*) as n, round(avg(value), 6) as mean, round(quantile_cont(value, 0.5), 6) as median, round(quantile_cont(value, 0.95), 6) as p95 from events group by 1")
def latency_summary(spark, sf):
    return diagnostics.latency(table(spark, sf, "events"), ["event_type"], "value")


@query("select event_type, count(*) as total, count(distinct user_id) as users, sum((value > 0)::int)::bigint as positive from events group by 1")
def request_counters(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("total"), F.count_distinct("user_id").alias("users"), F.count_if(F.col("value") > 0).alias("positive"))


@query("with p as (select user_id % 10 as config, round(avg(value), 6) as quality, round(quantile_cont(value, 0.95), 6) as cost from events group by 1) select config, quality, cost, not exists (select 1 from p b where b.quality >= p.quality and b.cost <= p.cost and (b.quality > p.quality or b.cost < p.cost)) as on_frontier from p")
def quality_latency_frontier(spark, sf):
    p = table(spark, sf, "events").groupBy((F.col("user_id") % 10).alias("config")).agg(F.round(F.avg("value"), 6).alias("quality"), F.round(F.percentile("value", 0.95), 6).alias("cost"))
    front = diagnostics.pareto(p).select("config", F.lit(True).alias("_f"))
    return p.join(front, "config", "left").select("config", "quality", "cost", F.coalesce("_f", F.lit(False)).alias("on_frontier"))


# texts with lines of each kind, next to the documents' own
PLANTED = [
    "-----BEGIN RSA PRIVATE KEY-----",
    "see /Users/someone/notes.txt",
    "x/home/no but (/Volumes/disk/yes)",
    "sk-abcdefghijklmnop1234",
    "api_key = 'abcdefgh12345678'",
    "password: short",
    "token sk-tooshort",
]
LINES = f"documents2 as (select doc_id, coalesce(text, '') as text from documents union all select * from (values {', '.join(f'({-1 - i}, {chr(39)}first line{chr(39)} || chr(10) || {chr(39)}{t.replace(chr(39), chr(39) * 2)}{chr(39)})' for i, t in enumerate(PLANTED))}) v(doc_id, text))"
FOUND = [
    ("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    ("token_prefix", "\\b(?:sk|ghp|xox[baprs])-[A-Za-z0-9_-]{16,}\\b"),
    ("credential_assignment", "(?i)\\b(?:api[_-]?key|access[_-]?token|client[_-]?secret|password)\\s*[:=]\\s*[\"'']?[A-Za-z0-9_./+=-]{16,}"),
    ("absolute_path", "(^|[^A-Za-z0-9])/(?:Users|Volumes|home)/[^\\s`\"'')]+"),
]


@query(
    f"with {LINES}, l as (select doc_id, unnest(string_split(text, chr(10))) as s, generate_subscripts(string_split(text, chr(10)), 1) as line from documents2) "
    + " union all ".join(f"select doc_id, line, '{n}' as finding from l where regexp_matches(s, '{p}')" for n, p in FOUND)
)
def line_findings(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    return diagnostics.line_findings(d.union(spark.createDataFrame([(-1 - i, f"first line\n{t}") for i, t in enumerate(PLANTED)], "doc_id long, text string")))


@query("select sha256(text) as digest, count(*) as n, min(doc_id) as first from documents group by 1 having count(*) > 1")
def duplicates_by_digest(spark, sf):
    return diagnostics.duplicates_by_digest(table(spark, sf, "documents").withColumn("text", F.coalesce("text", F.lit(""))), "text", "doc_id")


# sources


PAGE = (
    '<a href="http://h/img/123.jpg?x=1">x</a><ul><li> one  two </li><li>b &amp; c</li></ul> Image Not Found <ul><li>c</li></ul>'
    '<a href="about.html">no</a><a href=456.JPG></a><ul><li>d</li><li> </li></ul><p>image not found</p>'
)


@query(
    "select * from (values (-1, '123', '123.jpg', '123#0', 'one two'), (-1, '123', '123.jpg', '123#1', 'b & c'), (-1, 'missing-source-image-000002', null, 'missing-source-image-000002#0', 'c'),"
    " (-1, '456', '456.jpg', '456#0', 'd'), (-1, 'missing-source-image-000004', null, null, null)) v(page_id, group_id, filename, caption_id, text)"
)
def html_caption_parse(spark, sf):
    """The pages of the table, which hold no image links, and one that does."""
    pages = table(spark, sf, "pages").select("page_id", "html").union(spark.createDataFrame([(-1, PAGE)], "page_id long, html string"))
    return records.caption_pages(pages).select("page_id", "group_id", "filename", F.explode_outer("captions").alias("c")).select("page_id", "group_id", "filename", "c.caption_id", "c.text")


@query("select page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) as host, strlen(html)::bigint as bytes, len(regexp_extract_all(html, '<li[ >]'))::bigint as items, len(regexp_extract_all(html, '<a[ >]'))::bigint as links from pages")
def page_profile(spark, sf):
    h = F.col("html")
    return table(spark, sf, "pages").select(
        "page_id",
        F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1).alias("host"),
        F.octet_length(h).cast("long").alias("bytes"),
        F.regexp_count(h, F.lit("<li[ >]")).cast("long").alias("items"),
        F.regexp_count(h, F.lit("<a[ >]")).cast("long").alias("links"),
    )


# events as streams (an extension), in batch form


@query("select time_bucket(interval 5 minute, ts) as start, event_type, count(*) as n, round(sum(value), 6) as total from events group by 1, 2")
def event_windows(spark, sf):
    return streams.counters(table(spark, sf, "events"))


@query("select time_bucket(interval 5 minute, ts) as start, event_type, count(*) as n, round(sum(value), 6) as total from events group by 1, 2")
def event_windows_stream(spark, sf):
    # as many events late as the table holds: it is no log in order of arrival
    return streams.drain(streams.counters(streams.unique(streams.read(spark, f"{sf}/events.parquet"), "3650 days")), "start", "event_type")


@query(
    """with o as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minute then 0 else 1 end as first from events), s as (select *, sum(first) over (partition by user_id order by ts rows unbounded preceding) as k from o)
select user_id, min(ts) as start, max(ts) + interval 30 minute as "end", count(*) as n from s group by user_id, k"""
)
def event_sessions(spark, sf):
    return streams.sessions(table(spark, sf, "events"))


