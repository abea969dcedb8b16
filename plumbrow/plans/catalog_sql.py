"""Independent SQL statements (DuckDB dialect) for the checkable catalogue queries.

The statements rank whole strata with window functions; they state the meaning of the
queries, not the way the Spark versions are computed.
"""

from __future__ import annotations

LI_KEY = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
LI_ID = f"{LI_KEY}, l_quantity"
LINEITEM = (
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
    "l_returnflag", "l_linestatus", "l_shipdate",
)
LI3 = "l_quantity, l_discount, l_tax"
LI4 = f"{LI3}, l_linenumber"

LI = f"""li AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {LI3}, l_extendedprice,
         CAST(l_returnflag = 'R' AS INTEGER) AS label
  FROM lineitem)"""
EV = """ev AS (
  SELECT event_id, user_id, value, ts, CAST(event_type = 'error' AS INTEGER) AS label FROM events)"""
DOC = """doc AS (
  SELECT doc_id, text, source, {label} AS label FROM documents JOIN labels USING (doc_id))"""
EMB = """emb AS (
  SELECT vec_id, embedding, CAST(label >= 5 AS INTEGER) AS label FROM embeddings)"""
DIRTY = """dirty AS (
  SELECT event_id, label,
         CASE WHEN value > 200 THEN 'Infinity'::DOUBLE WHEN value > 150 THEN NULL
              WHEN value < 1 THEN '-Infinity'::DOUBLE WHEN value < 3 THEN 'NaN'::DOUBLE
              ELSE value END AS value
  FROM ev)"""


def hashed(key: str, seed: str = "42") -> str:
    parts = [f"CAST({k.strip()} AS VARCHAR)" for k in key.split(",")]
    spelled = ", ".join(f"coalesce(concat(length({p}), '=', {p}), '-')" for p in parts)
    return f"md5(concat_ws(':', '{seed}', {spelled}))"


def split_ctes(source: str, key: str, ties: str = "", share: str = "0.2::DOUBLE", seed: str = "42",
               head: str = "test", tail: str = "train", name: str = "sp") -> str:
    """Stratified split of ``source`` on ``label`` as CTEs ending in ``name``."""
    order = f"h, {ties}" if ties else "h"
    return f"""{name}_cls AS (SELECT label, count(*) AS n FROM {source} GROUP BY label),
{name}_tot AS (SELECT sum(n) AS n, CAST(ceil({share} * sum(n)) AS BIGINT) AS t FROM {name}_cls),
{name}_ex AS (
  SELECT label, floor(t * c.n / CAST(z.n AS DOUBLE)) AS f,
         t * c.n / CAST(z.n AS DOUBLE) - floor(t * c.n / CAST(z.n AS DOUBLE)) AS r, t
  FROM {name}_cls c, {name}_tot z),
{name}_q AS (
  SELECT label, f + CASE WHEN row_number() OVER (ORDER BY r DESC, label) <= t - sum(f) OVER () THEN 1 ELSE 0 END AS q
  FROM {name}_ex),
{name}_h AS (SELECT *, {hashed(key, seed)} AS h FROM {source}),
{name} AS (
  SELECT s.*, CASE WHEN row_number() OVER (PARTITION BY s.label ORDER BY {order}) <= q
                   THEN '{head}' ELSE '{tail}' END AS split
  FROM {name}_h s JOIN {name}_q USING (label))"""


def group_split_ctes(source: str, features: str, name: str = "gs") -> str:
    key = ", ".join(f"CAST({c.strip()} AS VARCHAR)" for c in features.split(","))
    return f"""{name}_g AS (SELECT DISTINCT {features} FROM {source}),
{name}_r AS (
  SELECT *, row_number() OVER (ORDER BY {hashed(key)}, {features}) AS rn, count(*) OVER () AS g FROM {name}_g),
{name} AS (
  SELECT s.*, CASE WHEN rn <= ceil(0.2::DOUBLE * g) THEN 'test' ELSE 'train' END AS split
  FROM {source} s JOIN {name}_r USING ({features}))"""


LI_SPLIT = split_ctes("li", LI_KEY, "l_quantity")
EV_SPLIT = split_ctes("ev", "event_id")
EMB_SPLIT = split_ctes("emb", "vec_id")


def ceiling(source: str, features: str) -> str:
    return f"""SELECT CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_groups,
  round_even((sum(n) - count(*)) / CAST(sum(n) AS DOUBLE), 4) AS duplicate_rate,
  count(*) FILTER (WHERE pos > 0 AND pos < n) AS conflicting_groups,
  CAST(coalesce(sum(n) FILTER (WHERE pos > 0 AND pos < n), 0) AS BIGINT) AS rows_in_conflicting_groups,
  round_even(100 * coalesce(sum(n) FILTER (WHERE pos > 0 AND pos < n), 0) / CAST(sum(n) AS DOUBLE), 2)
    AS rows_in_conflicting_groups_pct,
  round_even(sum(greatest(pos, n - pos)) / CAST(sum(n) AS DOUBLE), 4) AS deterministic_upper_bound
FROM (SELECT count(*) AS n, sum(label) AS pos FROM {source} GROUP BY {features})"""


def overlap(source: str, features: str) -> str:
    return f"""SELECT CAST(sum(a) AS BIGINT) AS n_train, CAST(sum(b) AS BIGINT) AS n_test,
  count(*) FILTER (WHERE a > 0 AND b > 0) AS shared_groups,
  CAST(coalesce(sum(b) FILTER (WHERE a > 0 AND b > 0), 0) AS BIGINT) AS test_rows_whose_vector_also_in_train,
  round_even(100 * coalesce(sum(b) FILTER (WHERE a > 0 AND b > 0), 0) / CAST(sum(b) AS DOUBLE), 2) AS test_rows_leaked_pct
FROM (SELECT count(*) FILTER (WHERE split = 'train') AS a, count(*) FILTER (WHERE split = 'test') AS b
      FROM {source} GROUP BY {features})"""


def entities(source: str, entity: str) -> str:
    return f"""SELECT
  (SELECT count(DISTINCT {entity}) FROM {source} WHERE split = 'train') AS distinct_entities_train,
  (SELECT count(DISTINCT {entity}) FROM {source} WHERE split = 'test') AS distinct_entities_test,
  (SELECT count(*) FROM (SELECT {entity} FROM {source} WHERE split = 'train' AND {entity} IS NOT NULL
     INTERSECT SELECT {entity} FROM {source} WHERE split = 'test' AND {entity} IS NOT NULL)) AS shared_entities,
  count(*) FILTER (WHERE seen) AS test_rows_with_entity_seen_in_train,
  round_even(100 * count(*) FILTER (WHERE seen) / CAST(count(*) AS DOUBLE), 2) AS test_rows_with_entity_seen_in_train_pct
FROM (SELECT {entity} IS NOT NULL AND {entity} IN
        (SELECT {entity} FROM {source} WHERE split = 'train' AND {entity} IS NOT NULL) AS seen
      FROM {source} WHERE split = 'test')"""


def duplicates(source: str, features: str) -> str:
    return f"""SELECT CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_groups,
  CAST(sum(n - 1) AS BIGINT) AS duplicate_rows,
  round_even(sum(n - 1) / CAST(sum(n) AS DOUBLE), 4) AS duplicate_rate
FROM (SELECT count(*) AS n FROM {source} GROUP BY {features})"""


def conflicts(source: str, features: str) -> str:
    return f"""SELECT count(*) FILTER (WHERE k > 1) AS conflicting_groups,
  CAST(coalesce(sum(n) FILTER (WHERE k > 1), 0) AS BIGINT) AS conflict_rows,
  round_even(coalesce(sum(n) FILTER (WHERE k > 1), 0) / CAST(sum(n) AS DOUBLE), 4) AS conflict_rate
FROM (SELECT count(*) AS n, count(DISTINCT label) AS k FROM {source} GROUP BY {features})"""


def long(section: str, query: str, columns: list[str]) -> str:
    """Unpivot one wide report row."""
    parts = [
        f"SELECT '{section}' AS section, 'all' AS item, '{c}' AS metric, CAST({c} AS DOUBLE) AS value FROM ({query})"
        for c in columns
    ]
    return "\nUNION ALL ".join(parts)


CEILING_COLUMNS = [
    "n_rows", "n_groups", "duplicate_rate", "conflicting_groups", "rows_in_conflicting_groups",
    "rows_in_conflicting_groups_pct", "deterministic_upper_bound",
]
OVERLAP_COLUMNS = ["n_train", "n_test", "shared_groups", "test_rows_whose_vector_also_in_train", "test_rows_leaked_pct"]
ENTITY_COLUMNS = [
    "distinct_entities_train", "distinct_entities_test", "shared_entities", "test_rows_with_entity_seen_in_train",
    "test_rows_with_entity_seen_in_train_pct",
]

AUDIT_REPORT = f"""WITH {LI},
jd AS (SELECT * REPLACE (round_even(l_quantity, 1) AS l_quantity, round_even(l_discount, 1) AS l_discount,
                         round_even(l_tax, 1) AS l_tax), l_quantity AS tie FROM li),
{split_ctes("jd", LI_KEY, "l_quantity")},
{group_split_ctes("jd", LI4)}
{long("exact", ceiling("li", LI4), CEILING_COLUMNS)}
UNION ALL {long("rounded", ceiling("jd", LI4), CEILING_COLUMNS)}
UNION ALL {long("random_split_overlap", overlap("sp", LI4), OVERLAP_COLUMNS)}
UNION ALL {long("group_split_overlap", overlap("gs", LI4), OVERLAP_COLUMNS)}
UNION ALL SELECT 'group_split_overlap', 'all', split || '_attack_rate', round_even(avg(CAST(label AS DOUBLE)), 4)
  FROM gs GROUP BY split
UNION ALL {long("entity_overlap_random_split", entities("sp", "l_suppkey"), ENTITY_COLUMNS)}"""


# ---------------------------------------------------------------- lookup scorer

CONFIGS = {"q": "l_quantity", "qd": "l_quantity, l_discount", "qdt": LI3, "qdtl": LI4}


def lookup(source: str, features: str, config: str, prior: str) -> str:
    """Scored test rows of one feature set."""
    on = " AND ".join(f"t.{c.strip()} = v.{c.strip()}" for c in features.split(","))
    return f"""SELECT '{config}' AS config, t.label, coalesce(v.s, ({prior})) AS score
FROM {source} t LEFT JOIN (
  SELECT {features}, avg(CAST(label AS DOUBLE)) AS s FROM {source} WHERE split = 'train' GROUP BY {features}) v ON {on}
WHERE t.split = 'test'"""


PRIOR = "SELECT avg(CAST(label AS DOUBLE)) FROM sp WHERE split = 'train'"
SCORED = (
    f"WITH {LI},\n{LI_SPLIT},\nsc AS (SELECT *, CAST(score >= 0.5 AS INTEGER) AS pred FROM (\n"
    + "\nUNION ALL ".join(lookup("sp", f, c, PRIOR) for c, f in CONFIGS.items())
    + "))"
)


def cells(by: str, source: str) -> str:
    return f"""SELECT {by},
  count(*) FILTER (WHERE label = 0 AND pred = 0) AS tn, count(*) FILTER (WHERE label = 0 AND pred = 1) AS fp,
  count(*) FILTER (WHERE label = 1 AND pred = 0) AS fn, count(*) FILTER (WHERE label = 1 AND pred = 1) AS tp
FROM {source} GROUP BY {by}"""


def guarded(num: str, den: str) -> str:
    return f"CASE WHEN ({den}) = 0 THEN 0.0::DOUBLE ELSE CAST({num} AS DOUBLE) / ({den}) END"


def attack(by: str, source: str) -> str:
    return f"""SELECT {by}, {guarded("tn + tp", "tn + fp + fn + tp")} AS accuracy,
  {guarded("tp", "tp + fn")} AS attack_recall, {guarded("tp", "tp + fp")} AS attack_precision,
  {guarded("2 * tp", "2 * tp + fp + fn")} AS attack_f1, {guarded("fp", "tn + fp")} AS false_positive_rate
FROM ({cells(by, source)})"""


def rounded(query: str, columns: list[str], keep: str, decimals: int = 6) -> str:
    """The same rows with some columns rounded."""
    return f"SELECT {keep}, " + ", ".join(f"round({c}, {decimals}) + 0.0 AS {c}" for c in columns) + f" FROM ({query})"


ATTACK_COLUMNS = ["accuracy", "attack_recall", "attack_precision", "attack_f1", "false_positive_rate"]


def per_class(source: str) -> str:
    c = cells("config", source)
    return f"""SELECT config, 0 AS class, {guarded("tn", "tn + fn")} AS precision, {guarded("tn", "tn + fp")} AS recall,
  {guarded("2 * tn", "2 * tn + fn + fp")} AS f1, tn + fp AS support FROM ({c})
UNION ALL SELECT config, 1, {guarded("tp", "tp + fp")}, {guarded("tp", "tp + fn")},
  {guarded("2 * tp", "2 * tp + fn + fp")}, fn + tp FROM ({c})"""


def running(source: str) -> str:
    return f"""SELECT config, pos, neg, sum(pos) OVER w AS ctp, sum(neg) OVER w AS cfp
FROM (SELECT config, score, sum(label) AS pos, sum(1 - label) AS neg FROM {source} GROUP BY config, score)
WINDOW w AS (PARTITION BY config ORDER BY score DESC ROWS UNBOUNDED PRECEDING)"""


def auc(source: str) -> str:
    return f"""SELECT config, sum(neg * (ctp - pos / 2.0::DOUBLE)) / (sum(pos) * CAST(sum(neg) AS DOUBLE)) AS auc_roc,
  sum(pos * ctp / CAST(ctp + cfp AS DOUBLE)) / CAST(sum(pos) AS DOUBLE) AS pr_auc FROM ({running(source)}) GROUP BY config"""


# ---------------------------------------------------------------- folds

FOLDS = """{name}_cls AS (
  SELECT label, count(*) AS n, coalesce(sum(count(*)) OVER (ORDER BY label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
    AS start FROM {source} GROUP BY label),
{name}_size AS (
  SELECT label, f, count(*) AS size FROM (
    SELECT label, (start + unnest(range(n))) % 5 AS f FROM {name}_cls) GROUP BY label, f),
{name}_end AS (
  SELECT label, f, sum(size) OVER (PARTITION BY label ORDER BY f) AS last,
         sum(size) OVER (PARTITION BY label ORDER BY f) - size AS before FROM {name}_size),
{name}_r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {hash}{ties}) AS rn FROM {source}),
{name} AS (SELECT r.*, CAST(e.f AS INTEGER) AS fold FROM {name}_r r JOIN {name}_end e
  ON r.label = e.label AND r.rn > e.before AND r.rn <= e.last)"""


def folds(source: str, key: str, ties: str = "", name: str = "fd") -> str:
    return FOLDS.format(source=source, name=name, hash=hashed(key, "42:folds"), ties=f", {ties}" if ties else "")


def fold_lookup(features: str, config: str) -> str:
    on = " AND ".join(f"t.{c.strip()} = v.{c.strip()}" for c in features.split(","))
    return f"""SELECT '{config}' AS config, t.fold, t.label,
  CASE WHEN v.n - h.n > 0 THEN CAST(v.p - h.p AS DOUBLE) / (v.n - h.n) ELSE z.prior END AS score
FROM fd t
JOIN (SELECT {features}, count(*) AS n, sum(label) AS p FROM fd GROUP BY {features}) v ON {on}
JOIN (SELECT {features}, fold, count(*) AS n, sum(label) AS p FROM fd GROUP BY {features}, fold) h
  ON {on.replace("v.", "h.")} AND t.fold = h.fold
JOIN (SELECT k.fold, (SELECT avg(CAST(label AS DOUBLE)) FROM fd o WHERE o.fold <> k.fold) AS prior
      FROM (SELECT DISTINCT fold FROM fd) k) z ON t.fold = z.fold"""


FOLD_METRICS = (
    f"WITH {LI},\n{folds('li', LI_KEY, 'l_quantity')},\nsc AS (SELECT *, CAST(score >= 0.5 AS INTEGER) AS pred FROM (\n"
    + "\nUNION ALL ".join(fold_lookup(f, c) for c, f in CONFIGS.items())
    + f")),\nam AS ({attack('config, fold', 'sc')}),\nfm AS (\n"
    + "\nUNION ALL ".join(
        f"SELECT config, fold, '{m}' AS metric, {m} AS value FROM am" for m in ("accuracy", "attack_recall", "attack_f1")
    )
    + ")"
)

PAIRED = f"""{FOLD_METRICS},
pr AS (SELECT a.metric, a.fold, b.value - a.value AS d FROM fm a JOIN fm b USING (metric, fold)
       WHERE a.config = 'q' AND b.config = 'qdtl'),
rk AS (SELECT metric, d, CASE WHEN d <> 0 THEN rank() OVER (PARTITION BY metric, d <> 0 ORDER BY abs(d))
         + (count(*) OVER (PARTITION BY metric, abs(d)) - 1) / 2.0::DOUBLE END AS r FROM pr)
SELECT metric, count(*) AS folds, round_even(avg(d), 4) + 0.0 AS mean_difference,
  round_even(avg(d) / (stddev_samp(d) / sqrt(count(*))), 4) + 0.0 AS t,
  coalesce(sum(r) FILTER (WHERE d > 0), 0.0::DOUBLE) AS w_plus,
  coalesce(sum(r) FILTER (WHERE d < 0), 0.0::DOUBLE) AS w_minus
FROM rk GROUP BY metric"""


# ---------------------------------------------------------------- transforms

LONG = f"""WITH {EMB},
{EMB_SPLIT},
lo AS (SELECT vec_id, split, generate_subscripts(embedding, 1) - 1 AS pos, CAST(unnest(embedding) AS DOUBLE) AS v FROM sp)"""
SCALED = f"""{LONG},
bd AS (SELECT pos, min(v) AS lo, max(v) AS hi FROM lo WHERE split = 'train' GROUP BY pos),
un AS (SELECT vec_id, split, pos, 2 * (v - bd.lo) / CASE WHEN bd.hi = bd.lo THEN 1 ELSE bd.hi - bd.lo END - 1 AS u
       FROM lo JOIN bd USING (pos)),
nm AS (SELECT vec_id, split, pos, least(greatest(u, -1.0::DOUBLE), 1.0::DOUBLE) AS x FROM un)"""


def positions(expression: str, base: str = SCALED, source: str = "nm", pos: str = "pos") -> str:
    return f"SELECT vec_id, CAST({pos} AS INTEGER) AS pos, round({expression}, 6) + 0.0 AS value FROM {source}"


BOUNDARY = f"""{SCALED},
er AS (SELECT *, abs(atan2(sin(x * pi()), cos(x * pi())) / pi() - x) AS e FROM nm WHERE split = 'test'),
te AS (SELECT * FROM un WHERE split = 'test')
SELECT count(*) AS test_values_total,
  count(*) FILTER (WHERE u < -1) AS values_below_minus1_before_clipping,
  count(*) FILTER (WHERE u > 1) AS values_above_plus1_before_clipping,
  round_even(100 * count(*) FILTER (WHERE abs(u) > 1) / CAST(count(*) AS DOUBLE), 4) AS out_of_range_rate_pct,
  count(DISTINCT vec_id) FILTER (WHERE abs(u) > 1) AS test_rows_with_at_least_one_out_of_range_value,
  round_even(100 * count(DISTINCT vec_id) FILTER (WHERE abs(u) > 1) / CAST(count(DISTINCT vec_id) AS DOUBLE), 3)
    AS test_rows_with_out_of_range_pct,
  count(*) FILTER (WHERE abs(u) > 1) AS values_that_would_alias_without_clipping,
  round_even(max(abs(u)), 4) AS max_absolute_normalized_value_before_clipping,
  (SELECT count(*) FROM er WHERE x = -1) AS values_clipped_to_minus1,
  (SELECT count(*) FROM er WHERE x = 1) AS values_clipped_to_plus1,
  least((SELECT count(*) FROM er WHERE x = -1), (SELECT count(*) FROM er WHERE x = 1)) AS endpoint_collision_pairs,
  (SELECT round(avg(e), 6) + 0.0 FROM er) AS inversion_error_mean_all,
  (SELECT round(max(e), 6) + 0.0 FROM er) AS inversion_error_max_all,
  (SELECT round(max(e), 6) + 0.0 FROM er WHERE abs(x) < 1) AS inversion_error_max_interior_only
FROM te"""


def imputed(where: str, clean: str, extra: str = "") -> str:
    return f"""SELECT event_id{extra}, round(CASE WHEN value IS NULL OR isnan(value) OR isinf(value)
  THEN (SELECT median(value) FROM dirty_s WHERE {clean} {where}) ELSE value END, 6) + 0.0 AS value FROM dirty_s"""


FINITE = "value IS NOT NULL AND NOT isnan(value) AND NOT isinf(value)"

def drawn(name: str) -> str:
    """Share of the range that a trial's digest gives a search parameter."""
    return f"(CAST('0x' || substr(md5('42:' || number || ':{name}'), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE)"


def picked(name: str, first: int, step: int, choices: int) -> str:
    return f"CAST({first} + {step} * floor({drawn(name)} * {choices}) AS INTEGER)"


# Values of the search space that are not evenly stepped: 64 128 256, 32 64, 24 32 48.
TRIAL_LISTING = f"""SELECT CAST(number AS INTEGER) AS number, {drawn('drop')} * 0.3::DOUBLE AS params_drop,
      [64, 128, 256][CAST(1 + floor({drawn('h1')} * 3) AS INTEGER)] AS params_h1, {picked('h2', 32, 32, 2)} AS params_h2,
      [24, 32, 48][CAST(1 + floor({drawn('ldim')} * 3) AS INTEGER)] AS params_ldim, {picked('max_d', 10, 1, 21)} AS params_max_d,
      {picked('n_est', 150, 50, 6)} AS params_n_est, 2 * [24, 32, 48][CAST(1 + floor({drawn('ldim')} * 3) AS INTEGER)] AS encoded_dim,
      'COMPLETE' AS state, CAST(1 AS BIGINT) AS attempts, true AS scored, true AS timed
    FROM range(4) t(number)"""

TUNING_CHAIN = """WITH n AS (SELECT count(*) AS n, CAST(ceil(0.2::DOUBLE * count(*)) AS BIGINT) AS valid_rows FROM embeddings),
    sizes AS (SELECT n - valid_rows AS train, least(15000, n - valid_rows) AS part, valid_rows FROM n),
    rows AS (
      SELECT 'architecture' AS stage, CAST(2 * w + a AS INTEGER) AS trial, 'latent=' || (16 * (w + 1)) || ' act=' || (['relu', 'tanh'])[a + 1] AS config,
        CAST(32 * (w + 1) AS INTEGER) AS dims, part AS fit_rows, valid_rows FROM range(2) x(w), range(2) y(a), sizes
      UNION ALL SELECT 'margin', CAST(3 * c + g AS INTEGER), 'C=' || ([1, 10, 100])[c + 1] || ' gamma=' || (['scale', '0.01', '0.1'])[g + 1],
        0, part, valid_rows FROM range(3) x(c), range(3) y(g), sizes
      UNION ALL SELECT 'final', 0, 'tuned', 0, train, valid_rows FROM sizes
      UNION ALL SELECT 'baseline', 0, 'forest', 0, train, valid_rows FROM sizes
    ) SELECT *, true AS by_rule, true AS handed_on, true AS scored FROM rows"""

ORACLE = {
    "drop_leaky_columns": """SELECT l_linenumber, round(l_quantity, 6) + 0.0 AS l_quantity,
        round(l_extendedprice, 6) + 0.0 AS l_extendedprice, round(l_discount, 6) + 0.0 AS l_discount,
        round(l_tax, 6) + 0.0 AS l_tax, l_returnflag, l_linestatus FROM lineitem""",
    "numeric_columns": """SELECT o_orderkey, o_custkey, round(o_totalprice, 6) + 0.0 AS o_totalprice,
        CAST(o_orderstatus = 'F' AS INTEGER) AS label FROM orders""",
    "provenance_label": """SELECT page_id,
        CAST(list_contains(string_split(url, '/'), 'https:') AS INTEGER) AS under_folder,
        CASE WHEN contains(string_split(url, '/')[-1], '1') THEN 0 ELSE 1 END AS label_by_name,
        CAST(contains(string_split(url, '/')[-1], '3') OR contains(string_split(url, '/')[-1], '7') AS INTEGER)
          AS matches_any,
        CAST(ends_with(lower(url), '.html') OR ends_with(lower(url), '5') AS INTEGER) AS has_suffix FROM pages""",
    "typed_casts": f"""WITH {LI} SELECT label, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity,
        CAST(sum(l_linenumber) AS BIGINT) AS lines FROM li GROUP BY label""",
    "class_filter": f"WITH {EV} SELECT event_id, user_id, value, label FROM ev WHERE label = 1",
    "class_names": f"""WITH {EV} SELECT CASE label WHEN 0 THEN 'benign' WHEN 1 THEN 'attack' END AS class,
        count(*) AS n FROM ev GROUP BY label""",
    "threshold_predictions": "SELECT event_id, CAST(value / 100.0 >= 0.25 AS INTEGER) AS pred FROM events",
    "inf_to_null": f"""WITH {EV}, {DIRTY}
        SELECT event_id, CASE WHEN {FINITE} THEN round(value, 6) + 0.0 END AS value FROM dirty""",
    "impute_median": f"WITH {EV}, {DIRTY}, dirty_s AS (SELECT * FROM dirty) {imputed('', FINITE)}",
    "impute_median_train": f"""WITH {EV}, {DIRTY}, {split_ctes("dirty", "event_id")},
        dirty_s AS (SELECT * FROM sp) {imputed("AND split = 'train'", FINITE, ", split")}""",
    "impute_median_legacy": f"""WITH {EV}, {DIRTY}, dirty_s AS (SELECT * FROM dirty)
        {imputed('', 'value IS NOT NULL AND NOT isnan(value)')}""",
    "feature_medians": "\nUNION ALL ".join(
        f"SELECT 'lineitem' AS \"table\", '{c}' AS metric, round(median({c}), 6) + 0.0 AS value FROM lineitem"
        for c in ("l_quantity", "l_discount", "l_tax", "l_extendedprice")
    ),
    "feature_moments": "\nUNION ALL ".join(
        f"""SELECT '{c}' AS feature, round(avg({c}), 6) + 0.0 AS mean, round(stddev_pop({c}), 6) + 0.0 AS std,
            round(min({c}), 6) + 0.0 AS min, round(max({c}), 6) + 0.0 AS max FROM lineitem"""
        for c in ("l_quantity", "l_discount", "l_tax", "l_extendedprice")
    ),
    "class_weights": f"""WITH {EV} SELECT label, count(*) AS n,
        round((SELECT count(*) FROM ev) / ((SELECT count(DISTINCT label) FROM ev) * CAST(count(*) AS DOUBLE)), 6) AS weight
        FROM ev GROUP BY label""",
    "weighted_rows": f"""WITH {EV} SELECT event_id, round((SELECT count(*) FROM ev)
        / (2 * CAST(count(*) OVER (PARTITION BY label) AS DOUBLE)), 6) AS weight FROM ev""",
    "positive_weight": f"""WITH {EV} SELECT label, count(*) AS n, (SELECT round(count(*) FILTER (WHERE label = 0)
        / CAST(count(*) FILTER (WHERE label = 1) AS DOUBLE), 6) FROM ev) AS weight FROM ev GROUP BY label""",
    "union_by_name": """SELECT c_name AS name, c_nationkey AS nation, c_mktsegment AS segment FROM customer
        UNION ALL SELECT s_name, s_nationkey, NULL FROM supplier""",
    "distinct_entities": "SELECT DISTINCT user_id AS entity FROM events WHERE user_id % 7 <> 0",
    "shared_vectors": f"""WITH {LI}, {LI_SPLIT} SELECT {LI4} FROM sp WHERE split = 'train'
        INTERSECT SELECT {LI4} FROM sp WHERE split = 'test'""",
    "attach_split": f"""WITH {EV}, {EV_SPLIT} SELECT split, count(*) AS n, round(avg(value), 6) AS mean_value
        FROM sp GROUP BY split""",
    "string_functions": """SELECT doc_id, upper(lang) AS lang, replace(source, 'a', '_') AS source,
        CAST(contains(text, 'the') AS INTEGER) AS has_the, CAST(ends_with(text, '.') AS INTEGER) AS ends_sentence
        FROM documents""",
    "hash_functions": "SELECT doc_id, md5(text) AS md5, sha256(text) AS sha256 FROM documents",
    "elapsed_seconds": """SELECT user_id, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0::DOUBLE, 6) AS seconds
        FROM events GROUP BY user_id""",
    "guarded_ratio": f"""WITH {EV} SELECT user_id, round(CASE WHEN count(*) FILTER (WHERE value > 20) = 0 THEN 0.0::DOUBLE
        ELSE sum(label) / CAST(count(*) FILTER (WHERE value > 20) AS DOUBLE) END, 6) AS ratio FROM ev GROUP BY user_id""",
    "elementwise_math": """SELECT event_id, round(cos(v), 6) + 0.0 AS cosine, round(sin(v), 6) + 0.0 AS sine,
        round((exp(v) - exp(-v)) / (exp(v) + exp(-v)), 6) + 0.0 AS tanh, round(atan2(sin(v), cos(v)) / pi(), 6) + 0.0 AS turn,
        round_even(value, 0) + 0.0 AS even, round(least(greatest(value, 1.0::DOUBLE), 20.0::DOUBLE), 6) + 0.0 AS clipped
        FROM (SELECT event_id, value, value / 10 AS v FROM events)""",
    "class_counts": f"WITH {LI} SELECT label, count(*) AS n FROM li GROUP BY label",
    "attack_rate_by_split": f"""WITH {EV}, {EV_SPLIT} SELECT split, count(*) AS n,
        round_even(avg(CAST(label AS DOUBLE)), 4) AS attack_rate FROM sp GROUP BY split""",
    "attack_rate_by_entity": f"""WITH {EV} SELECT user_id, count(*) AS n, round_even(avg(CAST(label AS DOUBLE)), 4) AS attack_rate
        FROM ev GROUP BY user_id""",
    "duplicate_rate": f"WITH {LI} {duplicates('li', LI4)}",
    "duplicate_rate_text": duplicates("documents", "text"),
    "duplicate_rows_flag": f"""SELECT {LI_ID}, CAST(row_number() OVER (PARTITION BY {LI4} ORDER BY {LI_ID}) > 1 AS INTEGER)
        AS is_duplicate FROM lineitem""",
    "duplicate_documents_flag": """SELECT doc_id, sha256(length(text) || '=' || text) AS vector,
        CAST(row_number() OVER (PARTITION BY text ORDER BY doc_id) > 1 AS INTEGER) AS is_duplicate FROM documents""",
    "label_conflicts": f"WITH {LI} {conflicts('li', LI4)}",
    "label_conflicts_text": f"WITH {DOC.format(label='quality')} {conflicts('doc', 'text')}",
    "conflict_rows": f"""WITH {LI} SELECT {LI_ID}, label FROM li WHERE ({LI4}) IN (
        SELECT ({LI4}) FROM li GROUP BY {LI4} HAVING count(DISTINCT label) > 1)""",
    "unique_attack_vectors": f"""WITH {LI} SELECT count(*) AS unique_vectors, CAST(sum(n) AS BIGINT) AS class_rows
        FROM (SELECT count(*) AS n FROM li WHERE label = 1 GROUP BY {LI4})""",
    "label_ceiling": f"WITH {LI} {ceiling('li', LI3)}",
    "label_ceiling_wide": f"WITH {LI} {ceiling('li', LI4)}",
    "label_ceiling_rounded": f"""WITH {EV}, rd AS (SELECT label, round_even(value, 0) AS value FROM ev)
        {ceiling('rd', 'value')}""",
    "label_ceiling_text": f"WITH {DOC.format(label='toxic')} {ceiling('doc', 'text')}",
    "vector_group_id": f"SELECT {LI_ID}, dense_rank() OVER (ORDER BY {LI3}) - 1 AS group_id FROM lineitem",
    "vector_key_counts": "SELECT min(doc_id) AS first_doc, count(*) AS n FROM documents GROUP BY text",
    "overlap_random": f"WITH {LI}, {LI_SPLIT} {overlap('sp', LI4)}",
    "overlap_grouped": f"WITH {LI}, {group_split_ctes('li', LI4)} {overlap('gs', LI4)}",
    "overlap_documents": f"WITH {DOC.format(label='quality')}, {split_ctes('doc', 'doc_id')} {overlap('sp', 'text')}",
    "entity_overlap": f"""WITH {EV}, {EV_SPLIT},
        en AS (SELECT *, CASE WHEN user_id % 5 <> 0 THEN user_id END AS entity FROM sp) {entities('en', 'entity')}""",
    "entity_overlap_documents": f"""WITH {DOC.format(label='quality')}, {split_ctes('doc', 'doc_id')}
        {entities('sp', 'source')}""",
    "audit_report": AUDIT_REPORT,
    "metric_delta": f"""WITH {LI}, {LI_SPLIT}, {group_split_ctes('li', LI3)},
        sc AS (SELECT *, CAST(score >= 0.5 AS INTEGER) AS pred FROM ({lookup('sp', LI3, 'random', PRIOR)}
          UNION ALL {lookup('gs', LI3, 'group', PRIOR)})),
        am AS ({attack('config', 'sc')})
        {" UNION ALL ".join(f"SELECT '{m}' AS metric, round_even(g.{m} - r.{m}, 4) + 0.0 AS delta FROM am g, am r WHERE g.config = 'group' AND r.config = 'random'" for m in ATTACK_COLUMNS)}""",
    "sample_fraction": f"""WITH {EV}, r AS (SELECT event_id, label, row_number() OVER (PARTITION BY label ORDER BY
        {hashed('event_id')}) AS rn, count(*) OVER (PARTITION BY label) AS n FROM ev)
        SELECT event_id, label FROM r WHERE label <> 0 OR rn <= round_even(0.1::DOUBLE * n, 0)""",
    "sample_per_class": f"""WITH {EV}, r AS (SELECT event_id, label, row_number() OVER (PARTITION BY label ORDER BY
        {hashed('event_id')}) AS rn FROM ev) SELECT event_id, label FROM r WHERE rn <= CASE label WHEN 0 THEN 1500 ELSE 700 END""",
    "sample_uniform": f"SELECT event_id FROM events ORDER BY {hashed('event_id')} LIMIT 1000",
    "stratified_split": f"WITH {LI}, {LI_SPLIT} SELECT {LI_ID}, label, split FROM sp",
    "stratified_split_events": f"WITH {EV}, {EV_SPLIT} SELECT event_id, label, split FROM sp",
    "dev_split": f"""WITH {EV}, {EV_SPLIT}, tr AS (SELECT event_id, label FROM sp WHERE split = 'train'
        ORDER BY {hashed('event_id', '42:dev')} LIMIT 2000),
        {split_ctes('tr', 'event_id', '', '0.25::DOUBLE', '42:dev:valid', 'valid', 'train', 'dv')}
        SELECT event_id, split FROM dv""",
    "stratified_folds": f"WITH {EV}, {folds('ev', 'event_id')} SELECT event_id, label, fold FROM fd",
    "group_split": f"WITH {LI}, {group_split_ctes('li', LI3)} SELECT {LI_ID}, split FROM gs",
    "validation_tail": f"""WITH r AS (SELECT event_id, row_number() OVER (ORDER BY {hashed('event_id', '42:tail')}) AS rn,
        count(*) OVER () AS n FROM events) SELECT event_id, CAST(rn > floor(n * (1 - 0.1::DOUBLE)) AS INTEGER) AS is_valid FROM r""",
    "standardize": f"""{LONG}, st AS (SELECT pos, avg(v) AS m, stddev_pop(v) AS s FROM lo WHERE split = 'train' GROUP BY pos)
        SELECT vec_id, CAST(pos AS INTEGER) AS pos, round((v - m) / CASE WHEN s = 0 THEN 1 ELSE s END, 6) + 0.0 AS value
        FROM lo JOIN st USING (pos)""",
    "minmax_clip": f"{SCALED} {positions('x')}",
    "angular_encode": f"""{SCALED} {positions('cos(x * pi())')}
        UNION ALL {positions('sin(x * pi())', pos='pos + 64')}""",
    "angular_inverse": f"{SCALED} {positions('atan2(sin(x * pi()), cos(x * pi())) / pi()')}",
    "identity_map": f"{LONG} {positions('v', source='lo')}",
    "cos_only": f"{SCALED} {positions('cos(x * pi())')}",
    "sin_only": f"{SCALED} {positions('sin(x * pi())')}",
    "tanh_map": f"{LONG} {positions('(exp(v) - exp(-v)) / (exp(v) + exp(-v))', source='lo')}",
    "poly2": f"""{SCALED}, pr AS (SELECT a.vec_id, a.pos AS i, b.pos AS j, a.x * b.x AS p
          FROM nm a JOIN nm b ON a.vec_id = b.vec_id AND a.pos <= b.pos),
        al AS (SELECT vec_id, p FROM pr UNION ALL SELECT vec_id, x FROM nm)
        SELECT vec_id, CAST(count(*) AS INTEGER) AS dims, round(sum(p), 6) + 0.0 AS total, round(sum(p * p), 6) + 0.0 AS squares,
          (SELECT round(p, 6) + 0.0 FROM pr f WHERE f.vec_id = al.vec_id AND i = 0 AND j = 0) AS first_square,
          (SELECT round(p, 6) + 0.0 FROM pr f WHERE f.vec_id = al.vec_id AND i = 63 AND j = 63) AS last_square
        FROM al GROUP BY vec_id""",
    "concat_features": f"{SCALED} {positions('v', source='lo')} UNION ALL {positions('x', pos='pos + 64')}",
    "boundary_report": BOUNDARY,
    "accuracy": f"{SCORED} SELECT config, round(avg(CAST(label = pred AS DOUBLE)), 6) + 0.0 AS accuracy FROM sc GROUP BY config",
    "confusion": f"{SCORED} {cells('config', 'sc')}",
    "per_class_prf": f"{SCORED} {rounded(per_class('sc'), ['precision', 'recall', 'f1'], 'config, class, support')}",
    "macro_weighted": f"""{SCORED} SELECT config, round(avg(precision), 6) + 0.0 AS macro_precision,
        round(avg(recall), 6) + 0.0 AS macro_recall, round(avg(f1), 6) + 0.0 AS macro_f1,
        round(sum(f1 * support) / sum(support), 6) + 0.0 AS weighted_f1 FROM ({per_class('sc')}) GROUP BY config""",
    "attack_metrics": f"{SCORED} {rounded(attack('config', 'sc'), ATTACK_COLUMNS, 'config')}",
    "roc_auc": f"{SCORED} SELECT config, round(auc_roc, 6) + 0.0 AS auc_roc FROM ({auc('sc')})",
    "average_precision": f"{SCORED} SELECT config, round(pr_auc, 6) + 0.0 AS pr_auc FROM ({auc('sc')})",
    "threshold_sweep": f"""{SCORED}, th AS (SELECT unnest([0.1::DOUBLE, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS threshold),
        ct AS (SELECT config, threshold, count(*) AS n, count(*) FILTER (WHERE label = 1) AS p,
          count(*) FILTER (WHERE label = 0) AS g, count(*) FILTER (WHERE label = 1 AND score >= threshold) AS tp,
          count(*) FILTER (WHERE label = 0 AND score >= threshold) AS fp FROM sc, th GROUP BY config, threshold)
        SELECT config, threshold, round({guarded('tp', 'tp + fp')}, 6) + 0.0 AS precision,
          round({guarded('tp', 'p')}, 6) + 0.0 AS recall, round({guarded('fp', 'g')}, 6) + 0.0 AS fpr,
          round(1000 * (tp + fp) / CAST(n AS DOUBLE), 6) + 0.0 AS alerts_per_1000 FROM ct""",
    "brier": f"""{SCORED} SELECT config, round(avg(pow(score - label, 2)), 6) + 0.0 AS brier_score,
        round(avg(CAST(label AS DOUBLE)), 6) + 0.0 AS positive_rate FROM sc GROUP BY config""",
    "scored_row_metrics": f"""WITH {EV}, sc AS (SELECT 'value' AS config, label, value / (value + 10) AS score,
          CAST(value / (value + 10) >= 0.5 AS INTEGER) AS pred FROM ev)
        SELECT a.config, {', '.join(f'round(a.{c}, 6) + 0.0 AS {c}' for c in ATTACK_COLUMNS)},
          round(auc_roc, 6) + 0.0 AS auc_roc, round(pr_auc, 6) + 0.0 AS pr_auc
        FROM ({attack('config', 'sc')}) a JOIN ({auc('sc')}) b USING (config)""",
    "fold_summary": f"""{FOLD_METRICS} SELECT config, metric, count(*) AS folds, round(avg(value), 6) + 0.0 AS mean,
        round(stddev_pop(value), 6) + 0.0 AS std FROM fm GROUP BY config, metric""",
    "paired_stats": PAIRED,
    "trial_listing": TRIAL_LISTING,
    "tuning_chain": TUNING_CHAIN,
    "leaderboard": f"""{SCORED} {rounded(attack('config', 'sc'), ATTACK_COLUMNS, 'config, CAST(rank() OVER (ORDER BY attack_f1 DESC) AS INTEGER) AS place')}""",
    "best_trial": f"""{SCORED} SELECT CAST(length(config) AS INTEGER) AS trial, config, round(accuracy, 6) + 0.0 AS accuracy
        FROM ({attack('config', 'sc')}) ORDER BY accuracy DESC, length(config) LIMIT 1""",
    "top_entities": f"""WITH {LI} SELECT l_suppkey, CAST(sum(label * 100000 + l_suppkey) AS BIGINT) AS value FROM li
        GROUP BY l_suppkey ORDER BY value DESC LIMIT 10""",
    "dataset_manifest": f"""WITH {EV} SELECT count(*) AS rows, 4 AS columns_total, 'label' AS label_column,
        count(*) FILTER (WHERE label = 0) AS benign, count(*) FILTER (WHERE label = 1) AS attack, 3 AS n_retained_features,
        'event_id,user_id,value' AS retained, 0 AS n_excluded_columns,
        count(*) - CAST(ceil(0.2::DOUBLE * count(*)) AS BIGINT) AS n_train, CAST(ceil(0.2::DOUBLE * count(*)) AS BIGINT) AS n_test
        FROM ev""",
    "csv_labelled_ingest": f"""WITH {LI} SELECT label, count(*) AS n, CAST(sum(l_orderkey) AS BIGINT) AS keys,
        round_even(sum(l_extendedprice), 2) AS price FROM li GROUP BY label""",
    "string_key_split": f"""WITH cu AS (SELECT c_name, c_mktsegment, CAST(c_acctbal < 0 AS INTEGER) AS label FROM customer),
        {split_ctes('cu', 'c_name, c_mktsegment', 'c_name, c_mktsegment')} SELECT c_name, split FROM sp""",
    "chunked_ingest": f"""WITH {EV} SELECT label, count(*) AS n FROM ev
        WHERE label <> 0 OR substring({hashed('event_id', '42:chunk')}, 1, 8) < '1999999a' GROUP BY label""",
    "stored_assignment": f"""WITH {EV}, {EV_SPLIT}, {folds('ev', 'event_id')}
        SELECT split, fold, count(*) AS n FROM sp JOIN fd USING (event_id) GROUP BY split, fold""",
    "column_profile": f"""SELECT CAST(row_number() OVER () - 1 AS INTEGER) AS position, d.column_name AS column,
        CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double'
          WHEN 'VARCHAR' THEN 'string' ELSE 'timestamp_ntz' END AS dtype,
        CASE WHEN d.column_name = 'l_returnflag' THEN 'label'
          WHEN column_type IN ('BIGINT', 'INTEGER', 'DOUBLE') THEN 'retained' ELSE 'excluded' END AS role, c.n AS n_values
        FROM (DESCRIBE lineitem) d POSITIONAL JOIN ({" UNION ALL ".join(f"SELECT count({c}) AS n FROM lineitem" for c in LINEITEM)}) c""",
    # 2.7764451051977987 is the two-sided 95 % quantile of Student's t with 4 degrees of freedom
    "confidence_intervals": f"""{FOLD_METRICS} SELECT config, metric, count(*) AS folds, round(avg(value), 6) + 0.0 AS mean,
        round(stddev_pop(value), 6) + 0.0 AS std,
        round(avg(value) - 2.7764451051977987::DOUBLE * stddev_samp(value) / sqrt(count(*)), 6) + 0.0 AS ci_low,
        round(avg(value) + 2.7764451051977987::DOUBLE * stddev_samp(value) / sqrt(count(*)), 6) + 0.0 AS ci_high
        FROM fm GROUP BY config, metric""",
}
