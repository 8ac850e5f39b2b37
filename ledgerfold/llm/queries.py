"""One query for each corpus operator, over its whole table, and SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, caps, importance, jaccard, licenses, merkle, mixing, pii, quality, repeats, token_counts, token_files, topk
from .common import shared_dir, table


def _file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document (see ``pii.find_pii``): one row a row, null texts as empty."""
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best other rows of every vector whose id is divisible by 50 (see ``topk.search``)."""
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token ids, written to segment files and read back (see ``token_files``)."""
    path = f"{shared_dir(spark)}/tokens"
    token_files.write_token_files(table(spark, sf_dir, "documents"), path, _file("byte_bpe_50k.json"), end_id=2)
    return token_files.read_token_files(spark, path).select("doc_id", "start", "n_tokens", token_files.crc32_of("ids"))


def op4_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors at cosine 0.9 (see ``caps.link``)."""
    return caps.link(table(spark, sf_dir, "embeddings"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document (see ``token_counts.count_tokens``)."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), _file("byte_bpe_50k.json"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences that every document states (see ``licenses.scan_licenses``)."""
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surprise of every document by trusted text, its limit, and whether it is kept (see ``quality.classify``)."""
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document (see ``mixing.mix``)."""
    return mixing.mix(table(spark, sf_dir, "documents"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of what they decode to (see ``bpe.round_trip``)."""
    return bpe.round_trip(table(spark, sf_dir, "documents"), _file("byte_bpe_50k.tiktoken"))


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents (see ``jaccard.join``)."""
    return jaccard.join(table(spark, sf_dir, "documents"))


def op11_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain counts of every document, and whether what it repeats lets it stay (see ``repeats.rules``)."""
    return repeats.rules(table(spark, sf_dir, "documents")).drop("spans")


def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's weight by the words of the benchmark, and its rank if it is drawn (see ``importance.resample``)."""
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, its proof, and whether it still folds to the root after line
    feeds of half the documents are gone (see ``merkle.manifest``)."""
    half = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    text = F.when(half, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return merkle.manifest(table(spark, sf_dir, "documents"), changed={"text": text})


QUERIES = {f.__name__: f for f in (op1_pii, op2_topk, op3_token_files, op4_caps, op5_token_counts, op6_licenses, op7_quality, op8_mixing, op9_bpe, op10_jaccard, op11_repeats, op12_resample, op13_manifest)}

_OP8 = r"""
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size, md5('mix:' || doc_id::varchar) as key
  from documents),
s as (select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) as place from d group by source),
r as (select *, [5.0, 2.0, 1.0][((place - 1) % 3 + 1)::int]::double as w, 3.0::double * source_size as cap from s),
l as (
  select *, (sum(source_size) over () - coalesce(sum(cap) over (order by cap / w, place rows between unbounded preceding and 1 preceding), 0))
    / sum(w) over (order by cap / w, place rows between current row and unbounded following) as level from r),
t as (
  select source, source_size,
    case when sum(source_size) over () = 0 then 0.0 else least(cap, coalesce(max(case when level * w <= cap then level end) over (), 0.0) * w) end::double as target
  from l),
p as (
  select *, case when source_size > 0 then floor(target / source_size) else 0 end::bigint as epochs from t),
x as (
  select d.doc_id, d.size, p.source_size, p.target, p.epochs, round(p.target)::bigint - p.epochs * p.source_size as rest,
    coalesce(sum(d.size) over (partition by d.source order by key, d.doc_id, d.size rows between unbounded preceding and 1 preceding), 0)::bigint as before
  from d join p on d.source is not distinct from p.source)
select doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, rest - before)))::bigint as taken from x
"""

_OP2 = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as vec from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.vec_id as query_id, c.vec_id, list_dot_product(q.vec, c.vec)::bigint as score
  from v q join v c on q.vec_id <> c.vec_id and len(q.vec) = len(c.vec) where q.vec_id % 50 = 0)
select query_id, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank, vec_id, score from s
qualify row_number() over (partition by query_id order by score desc, vec_id) <= 5
"""

_OP4 = """
with recursive v as (
  select vec_id, embedding::double[] as x from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
l as (select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id and len(a.x) = len(b.x) where list_cosine_similarity(a.x, b.x) >= 0.9),
r as (select vec_id as a, vec_id as b from embeddings union select r.a, l.b from r join l on r.b = l.a),
c as (select a, min(b) as component_id from r group by a),
n as (select a, count(*) as n from l group by a)
select e.vec_id, coalesce(n.n, 0)::bigint as n_links, c.component_id, e.vec_id = c.component_id as kept
from embeddings e join c on c.a = e.vec_id left join n on n.a = e.vec_id
"""

_OP10 = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (
  select doc_id, case when len(w) = 0 then []::varchar[] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end as sh from w),
e as (select doc_id, len(sh) as n, unnest(sh) as x from s),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c, max(a.n) as na, max(b.n) as nb from e a join e b on a.x = b.x and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from p where 100 * c >= 80 * (na + nb - c) union select b, a from p where 100 * c >= 80 * (na + nb - c)),
r as (select doc_id as a, doc_id as b from documents union select r.a, l.b from r join l on r.b = l.a),
c as (select a, min(b) as component_id from r group by a)
select s.doc_id, len(sh)::bigint as n_shingles, component_id from s join c on c.a = s.doc_id
"""

#: Unsigned crc-32 of every ``k`` of a table ``keys``, byte by byte.
_CRC = """
codes as (
  with recursive t(b, i, c) as (
    select range, 0, range::bigint from range(256) union all
    select b, i + 1, case when c % 2 = 1 then xor(c >> 1, 3988292384::bigint) else c >> 1 end from t where i < 8)
  select b::bigint as b, c from t where i = 8),
crc as (
  with recursive r(k, h, i, c) as (
    select k, hex(k), 0, 4294967295::bigint from keys union all
    select k, h, i + 1, xor(r.c >> 8, codes.c) from r join codes on codes.b = xor(r.c & 255, ('0x' || substr(h, 2 * i + 1, 2))::bigint)
    where i < length(h) // 2)
  select k, xor(c, 4294967295::bigint) as crc from r where i = length(h) // 2)
"""

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_OP12 = f"""
with d as (select doc_id, row_number() over () as r, {_WORDS} as w from documents),
f as (select r, unnest(w) as k from d), g as (select unnest({_WORDS}) as k from benchmark),
keys as (select k from f union select k from g), {_CRC},
s as (select crc % 10000 as b, count(*) as n from f join crc using (k) group by 1),
t as (select crc % 10000 as b, count(*) as n from g join crc using (k) group by 1),
gain as (
  select range as b, floor(1000 * ln(((coalesce(t.n, 0) + 1) * ((select count(*) from f) + 10000))::double / ((coalesce(s.n, 0) + 1) * ((select count(*) from g) + 10000))::double))::bigint as gain
  from range(10000) left join s on s.b = range left join t on t.b = range),
w as (select r, floor(sum(gain)::double / count(*))::bigint as weight from f join crc using (k) join gain on gain.b = crc % 10000 group by r),
x as (
  select doc_id, d.r, len(d.w)::bigint as n_features, coalesce(weight, 0)::bigint as weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint + 0.5::double) / 4294967296)))::bigint as score
  from d left join w using (r)),
y as (select r, row_number() over (order by score desc, doc_id nulls first, n_features)::bigint as rank from x where n_features >= 20)
select doc_id, n_features, weight, score::bigint as score, case when rank <= (select count(*) from y) * 10 // 100 then rank end as rank from x left join y using (r)
"""

_TOLD = "coalesce(strlen({0}::varchar)::varchar || ':' || {0}::varchar, '-')"
_LEAF = "sha256(" + " || ".join(_TOLD.format(c) for c in ("doc_id", "source", "lang", "n_chars", "{0}")) + ")"
_UP = """
  select {0}, level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' order by pos)) from {1} where n > 1 group by {0}, level, pos // 3, n"""
_BESIDE = """
  select a.nr, 1000 * {1} + a.level as level, coalesce(string_agg(b.h, '' order by b.pos) filter (b.pos < a.pos), '') as before, coalesce(string_agg(b.h, '' order by b.pos) filter (b.pos > a.pos), '') as behind
  from {2} a join {0} b on b.k = a.k and b.level = a.level and b.pos // 3 = a.pos // 3 where b.n > 1 group by a.nr, a.level"""

_OP13 = f"""
with recursive keys as (select distinct doc_id::varchar as k from documents where doc_id is not null), {_CRC},
d as (
  select doc_id, coalesce('s' || source, '') as k, {_LEAF.format("text")} as leaf, {_LEAF.format("(case when crc % 2 = 0 then replace(text, chr(10), '') else text end)")} as now, row_number() over () as nr
  from documents left join crc on crc.k = doc_id::varchar),
p as (select *, row_number() over (partition by k order by doc_id nulls first, leaf, nr) - 1 as pos, count(*) over (partition by k) as n from d),
t(k, level, pos, n, h) as (select k, 0, pos, n, leaf from p union all {_UP.format("k", "t")}),
sub as (select k, h, row_number() over (order by k) - 1 as pos, count(*) over () as n from t where n = 1),
u(k, level, pos, n, h) as (select '', 0, pos, n, h from sub union all {_UP.format("k", "u")}),
root as (select h as root from u where n = 1),
own as (select p.nr, t.k, t.level, t.pos from p join t on t.k = p.k and t.pos = p.pos // (3::bigint ** t.level)::bigint where t.n > 1),
over as (select p.nr, u.k, u.level, u.pos from p join sub on sub.k = p.k join u on u.pos = sub.pos // (3::bigint ** u.level)::bigint where u.n > 1),
path as (select *, row_number() over (partition by nr order by level) as step from ({_BESIDE.format("t", 0, "own")} union all {_BESIDE.format("u", 1, "over")})),
fold(nr, step, h) as (select nr, 0::bigint, now from p union all select f.nr, f.step + 1, sha256(before || h || behind) from fold f join path on path.nr = f.nr and path.step = f.step + 1),
folded as (select nr, max_by(h, step) as folded_root from fold group by nr),
proof as (select nr, sha256(string_agg(before || behind, '' order by step)) as proof_sha256 from path group by nr)
select doc_id, leaf, sub.h as subroot, root, coalesce(proof_sha256, sha256('')) as proof_sha256, folded_root, folded_root = root as verified
from p join sub using (k) join folded using (nr) left join proof using (nr), root
"""

ORACLE_SQL = {"op12_resample": _OP12, "op13_manifest": _OP13, "op10_jaccard": _OP10, "op2_topk": _OP2, "op4_caps": _OP4, "op6_licenses": licenses.oracle_sql(), "op8_mixing": _OP8}
