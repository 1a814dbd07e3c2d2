"""SQL for the corpus queries that SQL can express."""

from __future__ import annotations

_LOWER = """translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                     'abcdefghijklmnopqrstuvwxyz')"""

EXACT_DEDUP = f"""
with t as (select doc_id, sha256({_LOWER}) as text_sha256 from documents),
     g as (select text_sha256, max(doc_id) as keep_id, count(*) as group_size from t group by 1)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256
from t join g using (text_sha256)
"""


HARD_NEGATIVES = """
with rows as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         [floor(256 * x::double) for x in embedding] as q
  from embeddings
  where label is not null and embedding is not null
    and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
pairs as (
  select a.vec_id as anchor_id, b.vec_id as other_id, a.label = b.label as same,
         list_inner_product(a.q, b.q)::bigint as score
  from rows a join rows b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
positives as (
  select anchor_id, other_id as positive_id, score as positive_score
  from pairs where same
  qualify row_number() over (partition by anchor_id order by score desc, other_id) <= 5)
select anchor_id, positive_id, row_number() over (
         partition by anchor_id, positive_id order by score desc, other_id)::integer as rank,
       other_id as negative_id, positive_score, score as negative_score
from positives join pairs using (anchor_id)
where not same and 80 * positive_score <= 100 * score and score <= positive_score
qualify rank <= 5
"""


def all_sql() -> dict[str, str]:
    return {"op10_exact_dedup": EXACT_DEDUP, "op13_hard_negatives": HARD_NEGATIVES}
