"""The registered queries once more as SQL, written for DuckDB over the same tables."""

from __future__ import annotations

import math

from opinara.operators.kmeans import OVERSAMPLING, START_ROUNDS
from opinara.operators.regression import ITERATIONS, RIDGE
from opinara.operators.robust import EPS, GAMMA
from opinara.plans.queries import BUSINESS, DECORRELATION, PHI_ALPHA, PHI_DIGITS, PULL, PUSH, ROUNDS, SHORT_STEP, STEP, THETA_ALPHA, THETA_DIGITS, TOPICS

KS = range(TOPICS)
SPLIT = r"string_split_regex(lower(coalesce(text, '')), '[ \t\n\x0B\f\r]')"
DENSE_SMALL = 0.00001


def hash32(value: str) -> str:
    return f"CAST('0x' || substr(md5({value}), 1, 8) AS BIGINT)"


def unit(value: str) -> str:
    return f"(({hash32(value)} + 1) / CAST(4294967297.0 AS DOUBLE))"


def with_(ctes: list[tuple[str, str]], final: str) -> str:
    body = ",\n".join(f"{name} AS MATERIALIZED ({text})" for name, text in ctes)
    return f"WITH {body}\n{final}"


def cols(pattern: str) -> str:
    """The pattern once per topic, # standing for the topic."""
    return ", ".join(pattern.replace("#", str(k)) for k in KS)


def total(pattern: str) -> str:
    return " + ".join(pattern.replace("#", str(k)) for k in KS)


# -- text --------------------------------------------------------------------------


def counted(table: str = "documents", key: str = "doc_id") -> list[tuple[str, str]]:
    return [
        ("tok", f"SELECT {key} AS doc_id, unnest({SPLIT}) AS token FROM {table}"),
        ("cnt", "SELECT doc_id, token, count(*) AS n FROM tok WHERE token <> '' GROUP BY doc_id, token"),
    ]


def corpus() -> list[tuple[str, str]]:
    return counted() + [
        ("voc", "SELECT token, CAST(sum(n) AS BIGINT) AS n FROM cnt GROUP BY token HAVING sum(n) > 2"),
        ("bow", "SELECT doc_id, token, cnt.n FROM cnt JOIN voc USING (token)"),
        ("ids", "SELECT doc_id FROM documents"),
        ("lens", "SELECT ids.doc_id, CAST(coalesce(sum(n), 0) AS BIGINT) AS length FROM ids LEFT JOIN bow USING (doc_id) GROUP BY ids.doc_id"),
    ]


def tf(source: str = "documents") -> list[tuple[str, str]]:
    return counted(source) + [
        ("tf", f"SELECT doc_id, {hash32('token')} % 1000 AS bucket, CAST(sum(n) AS BIGINT) AS tf FROM cnt GROUP BY ALL"),
    ]


# -- topic models ------------------------------------------------------------------


def start_phi() -> list[tuple[str, str]]:
    raw = ", ".join(f"{unit(f'''token || ':{k}:0' ''')} AS c{k}" for k in KS)
    return [
        ("raw0", f"SELECT token, {raw} FROM voc"),
        ("phi0", f"SELECT token, {cols('c# / (SELECT sum(c#) FROM raw0) AS p#')} FROM raw0"),
    ]


def start_theta(prefix: str = "") -> list[tuple[str, str]]:
    uniform = cols(f"CAST({1.0 / TOPICS} AS DOUBLE) AS t#")
    return [(f"{prefix}theta0", f"SELECT doc_id, {uniform} FROM {prefix}ids")]


def rows(i: int, prefix: str = "", phi: str | None = None) -> tuple[str, str]:
    phi = phi or f"phi{i}"
    return (
        f"{prefix}rows{i}",
        f"SELECT doc_id, token, n, {cols('t#')}, {cols('p#')}, {total('p# * t#')} AS z"
        f" FROM {prefix}bow JOIN {prefix}theta{i} USING (doc_id) JOIN {phi} USING (token)",
    )


NO_PRIOR = "{c}"


def share_of(k: int) -> str:
    return f"sum(t{k} * d{k}) / sum({total('t# * d#')})"


def pulled_apart(k: int, i: int) -> str:
    """What a word loses in topic k to the topics that overlap with it over all words."""
    others = " + ".join(f"(SELECT sum(p{k} * p{s}) FROM phi{i}) * p{s}" for s in KS if s != k)
    return f"{DECORRELATION!r}::DOUBLE * p{k} * ({others})"


def overlap_density(i: int) -> str:
    squares = " + ".join(f"pow((SELECT sum(p{s} * p{t}) FROM phi{i}), 2)" for t in KS for s in range(t))
    return f"(-{DECORRELATION / 2!r}::DOUBLE * ({squares}))"


def next_theta(i: int, prior: str = NO_PRIOR, prefix: str = "", source: str | None = None, more: str = "") -> list[tuple[str, str]]:
    source = source or f"{prefix}rows{i}"
    counts = ", ".join(
        prior.format(c=f"coalesce(t{k} * d{k}, 0)", old=f"t{k}", part=f"(SELECT {share_of(k)} FROM {prefix}theta{i} JOIN {prefix}dsum{i} USING (doc_id))")
        + f" AS c{k}"
        for k in KS
    )
    keep = cols("CASE WHEN total > 0 THEN c# / total ELSE t# END AS t#")
    return [
        (
            f"{prefix}dsum{i}",
            f"SELECT doc_id, {cols('sum(CASE WHEN z > 0 THEN n / z END * p#) AS d#')}{', ' + more if more else ''}"
            f" FROM {source} GROUP BY doc_id",
        ),
        (
            f"{prefix}dcnt{i}",
            f"SELECT doc_id, {cols('t#')}, {counts} FROM {prefix}theta{i} LEFT JOIN {prefix}dsum{i} USING (doc_id)",
        ),
        (
            f"{prefix}theta{i + 1}",
            f"SELECT doc_id, {keep} FROM (SELECT *, {total('c#')} AS total FROM {prefix}dcnt{i})",
        ),
    ]


def next_phi(i: int, prior: str = NO_PRIOR, source: str | None = None) -> list[tuple[str, str]]:
    source = source or f"rows{i}"
    counts = ", ".join(
        prior.format(c=f"coalesce(p{k} * w{k}, 0)", old=f"p{k}", all=total("p#"), apart=pulled_apart(k, i)) + f" AS c{k}" for k in KS
    )
    return [
        (f"wsum{i}", f"SELECT token, {cols('sum(CASE WHEN z > 0 THEN n / z END * t#) AS w#')} FROM {source} GROUP BY token"),
        (f"wcnt{i}", f"SELECT token, {counts} FROM phi{i} LEFT JOIN wsum{i} USING (token)"),
        (f"phi{i + 1}", f"SELECT token, {cols(f'c# / (SELECT sum(c#) FROM wcnt{i}) AS p#')} FROM wcnt{i}"),
    ]


def em(theta_prior: str = NO_PRIOR, phi_prior: str = NO_PRIOR) -> list[tuple[str, str]]:
    ctes = corpus() + start_phi() + start_theta()
    for i in range(ROUNDS):
        ctes += [rows(i)] + next_theta(i, theta_prior) + next_phi(i, phi_prior)
    return ctes


def fold_in_corpus() -> list[tuple[str, str]]:
    return [
        ("xtok", f"SELECT item_id AS doc_id, unnest({SPLIT}) AS token FROM benchmark"),
        ("xbow", "SELECT doc_id, token, count(*) AS n FROM xtok JOIN voc USING (token) GROUP BY doc_id, token"),
        ("xids", "SELECT item_id AS doc_id FROM benchmark"),
    ]


APART = "greatest(0.0::DOUBLE, {c} - {apart})"


def dirichlet(alpha: float) -> str:
    return f"greatest(0.0::DOUBLE, {{c}} + ({alpha - 1.0!r}))"


def log_density(alpha: float, n: str, terms: str) -> str:
    return f"(lgamma({n} * {alpha}) - {n} * lgamma({alpha}) + ({alpha - 1.0!r}) * ({terms}))"


THETA_DENSITY = log_density(THETA_ALPHA, str(TOPICS), total(f"ln(t# + {DENSE_SMALL})"))


def phi_density(k: int, phi: str) -> str:
    return (
        f"(SELECT lgamma(count(*) * {PHI_ALPHA}::DOUBLE) - count(*) * lgamma({PHI_ALPHA}::DOUBLE)"
        f" + ({PHI_ALPHA - 1.0!r}) * sum(ln(p{k} + {DENSE_SMALL})) FROM {phi})"
    )


def log_sum(source: str, weight: str = "z") -> str:
    return f"(SELECT sum(CASE WHEN z > 0 THEN n * ln({weight}) ELSE '-infinity'::DOUBLE END) FROM {source})"


def perplexity_of(parts: list[str], length: str = "(SELECT sum(length) FROM lens)") -> str:
    selects = [
        f"SELECT CAST({i} AS INTEGER) AS iteration, round(exp(-({part}) / {length}), 4) AS perplexity"
        for i, part in enumerate(parts)
    ]
    return " UNION ALL ".join(selects)


def theta_sql(ctes: list[tuple[str, str]], name: str) -> str:
    return with_(ctes, f"SELECT doc_id, {cols(f'round(t#, {THETA_DIGITS}) AS t#')} FROM {name}")


def phi_sql(ctes: list[tuple[str, str]], name: str) -> str:
    return with_(ctes, f"SELECT token, {cols(f'round(p#, {PHI_DIGITS}) AS p#')} FROM {name}")


# -- robust --------------------------------------------------------------------------


def robust_rows(i: int, prefix: str = "", phi: str | None = None, bg: str | None = None) -> tuple[str, str]:
    phi, bg = phi or f"phi{i}", bg or f"{prefix}bg{i}"
    return (
        f"{prefix}rows{i}",
        f"SELECT doc_id, token, n, noise, bg, {cols('t#')}, {cols('p#')},"
        f" ({EPS} * noise + {GAMMA} * bg + {total('p# * t#')}) / {1 + EPS + GAMMA!r} AS z"
        f" FROM {prefix}noise{i} JOIN {prefix}theta{i} USING (doc_id) JOIN {phi} USING (token) JOIN {bg} USING (token)",
    )


def robust_start(prefix: str = "") -> list[tuple[str, str]]:
    return [
        (
            f"{prefix}noise0",
            f"SELECT doc_id, token, n, 1.0::DOUBLE / sum(n) OVER (PARTITION BY doc_id) AS noise FROM {prefix}bow",
        ),
        (f"{prefix}bg0", "SELECT token, 1.0::DOUBLE / (SELECT count(*) FROM voc) AS bg FROM voc"),
    ]


def robust_round(i: int, prefix: str = "") -> list[tuple[str, str]]:
    source = f"{prefix}rows{i}"
    return [
        (
            f"{prefix}x{i}",
            f"SELECT doc_id, token, n, coalesce({EPS} * noise * CASE WHEN z > 0 THEN n / z END, 0) AS x FROM {source}",
        ),
        (
            f"{prefix}noise{i + 1}",
            f"SELECT doc_id, token, n, CASE WHEN s > 0 THEN x / s ELSE 0 END AS noise"
            f" FROM (SELECT *, sum(x) OVER (PARTITION BY doc_id) AS s FROM {prefix}x{i})",
        ),
        (
            f"{prefix}b{i}",
            f"SELECT voc.token, coalesce(sum({GAMMA} * bg * CASE WHEN z > 0 THEN {source}.n / z END), 0) AS b"
            f" FROM voc LEFT JOIN {source} USING (token) GROUP BY voc.token",
        ),
        (f"{prefix}bg{i + 1}", f"SELECT token, b / (SELECT sum(b) FROM {prefix}b{i}) AS bg FROM {prefix}b{i}"),
    ]


def robust_em(theta_prior: str = NO_PRIOR, phi_prior: str = NO_PRIOR) -> list[tuple[str, str]]:
    ctes = corpus() + start_phi() + start_theta() + robust_start()
    for i in range(ROUNDS):
        ctes += [robust_rows(i)] + next_theta(i, theta_prior) + next_phi(i, phi_prior) + robust_round(i)
    return ctes


def robust_folded(background: str | None) -> list[tuple[str, str]]:
    ctes = robust_em() + fold_in_corpus() + start_theta("x") + robust_start("x")
    for i in range(ROUNDS):
        ctes += [robust_rows(i, "x", f"phi{ROUNDS}", background)]
        ctes += next_theta(i, prefix="x") + robust_round(i, "x")
    return ctes


def folded() -> list[tuple[str, str]]:
    ctes = em() + fold_in_corpus() + start_theta("x")
    for i in range(ROUNDS):
        ctes += [rows(i, "x", f"phi{ROUNDS}")] + next_theta(i, prefix="x")
    return ctes


# -- ranking ---------------------------------------------------------------------------

DISTANCES = [
    ("p", "SELECT vec_id AS doc_id, label, unnest(range(len(embedding))) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings"),
    ("c", "SELECT CAST(label AS BIGINT) AS cluster_id, i, avg(v) AS v FROM p GROUP BY label, i"),
    ("d", "SELECT doc_id, cluster_id, sum((p.v - c.v) * (p.v - c.v)) AS distance FROM p JOIN c USING (i) GROUP BY doc_id, cluster_id"),
]


def nth(partition: str, order: str, n: int, columns: str = "doc_id, cluster_id, round(distance, 6) AS distance", where: str = "true") -> str:
    return with_(
        DISTANCES,
        f"SELECT {columns} FROM (SELECT *, row_number() OVER ({partition} ORDER BY {order}) AS r FROM d WHERE {where}) WHERE r = {n}",
    )


def many(partition: str, order: str, n: int) -> str:
    pairs = [
        DISTANCES[0],
        (
            "d",
            "SELECT a.doc_id, b.doc_id AS cluster_id, sum((a.v - b.v) * (a.v - b.v)) AS distance"
            " FROM p a JOIN p b ON a.i = b.i AND a.doc_id % 2 = 1 AND b.doc_id % 2 = 0 GROUP BY ALL",
        ),
    ]
    return with_(
        pairs,
        f"SELECT doc_id, cluster_id, round(distance, 6) AS distance"
        f" FROM (SELECT *, row_number() OVER ({partition} ORDER BY {order}) AS r FROM d) WHERE r = {n}",
    )


USABLE = "doc_id % 11 <> 0 AND doc_id % 13 <> 0 AND doc_id % 17 <> 0 AND doc_id % 19 <> 0"
JSON_LINE = "('{\"doc_id\":' || doc_id || ',\"business_id\":\"' || source || '\",\"text\":\"')"

PREDICTED = tf() + [
    ("w", f"SELECT range AS bucket, {unit('CAST(range AS VARCHAR)')} - 0.5 AS weight FROM range(1000)"),
    ("known", "SELECT doc_id, sum(tf * weight) AS prediction FROM tf JOIN w USING (bucket) GROUP BY doc_id"),
    ("pred", "SELECT doc_id, coalesce(prediction, 0.0) AS prediction FROM documents LEFT JOIN known USING (doc_id)"),
    ("shown", "SELECT doc_id, round(prediction, 6) AS prediction FROM pred"),
]


def gradient(step: float, ridge: float, rounds: int) -> str:
    ctes = [
        ("lab", "SELECT doc_id, text, CAST(quality AS DOUBLE) AS label FROM documents JOIN labels USING (doc_id)"),
        *tf("lab"),
        ("buckets", "SELECT range AS bucket FROM range(1000)"),
        ("w0", "SELECT bucket, 0.0::DOUBLE AS weight FROM buckets"),
    ]
    for i in range(rounds):
        size = step / math.sqrt(i + 1)
        ctes += [
            (
                f"e{i}",
                f"SELECT lab.doc_id, coalesce(sum(tf * weight), 0) - any_value(label) AS error"
                f" FROM lab LEFT JOIN tf USING (doc_id) LEFT JOIN w{i} USING (bucket) GROUP BY lab.doc_id",
            ),
            (f"g{i}", f"SELECT bucket, sum(error * tf) / (SELECT count(*) FROM lab) AS g FROM tf JOIN e{i} USING (doc_id) GROUP BY bucket"),
            (
                f"w{i + 1}",
                f"SELECT bucket, weight * {1 - size * ridge!r} - {size!r} * coalesce(g, 0) AS weight FROM w{i} LEFT JOIN g{i} USING (bucket)",
            ),
        ]
    return with_(ctes, f"SELECT bucket, round(weight, 8) AS weight FROM w{rounds}")


def gradients(rounds: int, step: float) -> str:
    return " UNION ALL ".join(
        f"SELECT '{name}' AS model, * FROM ({gradient(step, ridge, rounds)})" for name, ridge in (("linear", 0.0), ("ridge", RIDGE))
    )


# -- clusterings of all businesses ----------------------------------------------------


def grouped() -> list[tuple[str, str]]:
    return tf() + [
        ("own", "SELECT doc_id, source AS business_id FROM documents"),
        ("sq", "SELECT doc_id, CAST(sum(tf * tf) AS DOUBLE) AS norm FROM tf GROUP BY doc_id"),
        ("pt", "SELECT doc_id, business_id, coalesce(norm, 0) AS norm FROM own LEFT JOIN sq USING (doc_id)"),
        ("ptf", "SELECT business_id, doc_id, bucket, tf FROM tf JOIN own USING (doc_id)"),
        (
            "luck",
            f"SELECT *, row_number() OVER (PARTITION BY business_id ORDER BY {hash32("CAST(doc_id AS VARCHAR) || ':0'")}, doc_id) AS r FROM pt",
        ),
    ]


def to_centers(name: str, values: str, norms: str) -> list[tuple[str, str]]:
    """``name``: the distance of each review to each center (cluster_id, bucket, v; cluster_id, norm) of its business."""
    return [
        (f"{name}dot", f"SELECT doc_id, cluster_id, sum(tf * v) AS dot FROM ptf JOIN {values} USING (business_id, bucket) GROUP BY doc_id, cluster_id"),
        (
            name,
            f"SELECT business_id, doc_id, cluster_id, greatest(0, pt.norm - 2 * coalesce(dot, 0) + c.norm) AS distance"
            f" FROM pt JOIN {norms} c USING (business_id) LEFT JOIN {name}dot USING (doc_id, cluster_id)",
        ),
    ]


def kmeans_rounds(rounds: int, k: int = TOPICS) -> list[tuple[str, str]]:
    """``cv``/``cn``: components and norms of the centers by round; ``near``: the cluster of each review among the last ones."""
    nearest = "SELECT * FROM {0} QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(distance, 6), cluster_id) = 1"
    ctes = grouped() + [
        ("first", f"SELECT business_id, r - 1 AS cluster_id, doc_id FROM luck WHERE r <= {k}"),
        ("cv0", "SELECT business_id, cluster_id, bucket, CAST(tf AS DOUBLE) AS v FROM first JOIN tf USING (doc_id)"),
    ]
    for i in range(rounds + 1):
        ctes.append(
            (
                f"cn{i}",
                f"SELECT business_id, cluster_id, coalesce(sum(v * v), 0) AS norm FROM first LEFT JOIN cv{i} USING (business_id, cluster_id) GROUP BY ALL",
            )
        )
        ctes += to_centers(f"dist{i}", f"cv{i}", f"cn{i}")
        if i == rounds:
            return ctes + [("near", nearest.format(f"dist{i}"))]
        ctes += [
            (f"in{i}", nearest.format(f"dist{i}")),
            (f"n{i}", f"SELECT business_id, cluster_id, count(*) AS n FROM in{i} GROUP BY ALL"),
            (
                f"cv{i + 1}",
                f"SELECT business_id, cluster_id, bucket, sum(tf) / any_value(n) AS v"
                f" FROM in{i} JOIN tf USING (doc_id) JOIN n{i} USING (business_id, cluster_id) GROUP BY business_id, cluster_id, bucket"
                f" UNION ALL SELECT business_id, cluster_id, bucket, v FROM cv{i} ANTI JOIN n{i} USING (business_id, cluster_id)",
            ),
        ]
    raise AssertionError


def parallel_draws(rounds: int = START_ROUNDS, expected: float = OVERSAMPLING * TOPICS) -> list[tuple[str, str]]:
    ctes = grouped() + [("drawn0", "SELECT business_id, doc_id, 0 AS place FROM luck WHERE r = 1")]
    for i in range(rounds + 1):
        ctes += [
            (f"pv{i}", f"SELECT business_id, place AS cluster_id, bucket, tf AS v FROM drawn{i} JOIN ptf USING (business_id, doc_id)"),
            (f"pn{i}", f"SELECT business_id, place AS cluster_id, norm FROM drawn{i} JOIN pt USING (business_id, doc_id)"),
        ]
        ctes += to_centers(f"pd{i}", f"pv{i}", f"pn{i}")
        ctes.append((f"least{i}", f"SELECT * FROM pd{i} QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY distance, cluster_id) = 1"))
        if i < rounds:
            draw = unit(f"CAST(doc_id AS VARCHAR) || ':0:{i + 1}'")
            ctes += [
                (f"cost{i}", f"SELECT business_id, sum(distance) AS cost FROM least{i} GROUP BY business_id"),
                (f"last{i}", f"SELECT business_id, max(place) AS last FROM drawn{i} GROUP BY business_id"),
                (
                    f"drawn{i + 1}",
                    f"SELECT * FROM drawn{i} UNION ALL"
                    f" SELECT business_id, doc_id, last + row_number() OVER (PARTITION BY business_id ORDER BY doc_id) AS place"
                    f" FROM least{i} JOIN cost{i} USING (business_id) JOIN last{i} USING (business_id) WHERE {draw} * cost < {expected} * distance",
                ),
            ]
    return ctes + [("weights", f"SELECT business_id, cluster_id AS place, count(*) AS weight FROM least{rounds} GROUP BY ALL")]


def every_ranking() -> str:
    ctes = kmeans_rounds(ROUNDS) + PREDICTED[len(tf()) :] + [
        ("large", "SELECT source AS business_id FROM documents GROUP BY source HAVING count(*) > 5"),
        (
            "best",
            "SELECT business_id, doc_id, prediction FROM shown JOIN own USING (doc_id) JOIN large USING (business_id)"
            " QUALIFY row_number() OVER (PARTITION BY business_id ORDER BY prediction DESC, doc_id) = 1",
        ),
        (
            "far",
            f"SELECT d.* FROM dist{ROUNDS} d JOIN best USING (business_id, doc_id)"
            " QUALIFY row_number() OVER (PARTITION BY business_id ORDER BY round(distance, 6) DESC, cluster_id) = 1",
        ),
        (
            "close",
            f"SELECT d.* FROM dist{ROUNDS} d JOIN far USING (business_id, cluster_id)"
            " QUALIFY row_number() OVER (PARTITION BY business_id ORDER BY round(d.distance, 6), d.doc_id) = 1",
        ),
    ]
    return with_(
        ctes,
        "SELECT business_id, best.doc_id AS most_useful_doc_id, prediction AS useful_pred, far.cluster_id AS furthest_cluster_id,"
        " round(far.distance, 6) AS furthest_distance, close.doc_id AS closest_doc_id, round(close.distance, 6) AS closest_distance"
        " FROM best JOIN far USING (business_id) JOIN close USING (business_id)",
    )


def oracle() -> dict[str, str]:
    train = f"{hash32('CAST(doc_id AS VARCHAR)')} % 100 < 70"
    counts = "SELECT source AS business_id, count(*) AS review_count FROM documents GROUP BY source"
    priors = [dirichlet(THETA_ALPHA), dirichlet(PHI_ALPHA)]
    last = ROUNDS
    new_length = "(SELECT sum(n) FROM xbow)"
    regularized_parts = [
        f"{log_sum(f'rows{i}')} + (SELECT sum({THETA_DENSITY}) FROM theta{i}) + "
        + " + ".join(phi_density(k, f"phi{i}") for k in KS)
        for i in range(last + 1)
    ]
    business = f"SELECT doc_id, text FROM documents WHERE source = '{BUSINESS}'"
    drawn = "ORDER BY " + hash32("business_id || ':0'") + ", business_id LIMIT 1"
    clustered = "SELECT doc_id, true AS nearest, true AS cost_holds FROM documents"
    errors_hold = "SELECT model, true AS mse_holds, true AS rmse_holds{more} FROM (VALUES ('linear'), ('ridge')) AS m(model)"
    return {
        # What solvers find is beyond SQL: these say which rows there are, and that every check of a row is true.
        "save_load_model": "SELECT doc_id, true AS linear_same, true AS ridge_same FROM documents",
        "kmeans_reviews": f"{clustered} WHERE source = '{BUSINESS}'",
        "kmeans_tfidf": clustered,
        "kmeans_theta": clustered,
        "kmeans_every_business": with_(
            kmeans_rounds(ROUNDS), "SELECT business_id, doc_id, cluster_id, round(distance, 6) AS distance FROM near"
        ),
        "kmeans_every_center": with_(
            kmeans_rounds(ROUNDS), f"SELECT business_id, cluster_id, bucket, round(v, 8) AS value FROM cv{ROUNDS} WHERE v <> 0"
        ),
        "kmeans_parallel_draws": with_(
            parallel_draws(), f"SELECT business_id, doc_id, place, weight FROM drawn{START_ROUNDS} JOIN weights USING (business_id, place)"
        ),
        "rank_every_business": every_ranking(),
        "centroids": "SELECT range AS center_id, CAST(1000 AS INTEGER) AS width, true AS own FROM range(5)",
        "lda_reviews": f"SELECT doc_id, true AS is_mixture, true AS settled, true AS loglik_holds FROM documents WHERE source = '{BUSINESS}'",
        "lda_term_counts": with_(
            tf(), f"SELECT bucket, CAST(sum(tf) AS DOUBLE) AS n FROM tf JOIN documents USING (doc_id) WHERE source = '{BUSINESS}' GROUP BY bucket"
        ),
        "linear_useful": "SELECT range AS bucket, true AS stationary FROM range(1000)",
        "ridge_useful": "SELECT range AS bucket, true AS stationary FROM range(1000)",
        "useful_models": errors_hold.format(more=""),
        "train_all": errors_hold.format(more=", true AS cost_holds, true AS loglik_holds"),
        "observe": f"SELECT doc_id, text, true AS pred_holds, true AS nearest FROM documents WHERE source = '{BUSINESS}'",
        "rank_instance": f"SELECT business_id, true AS best_holds, true AS furthest_holds, true AS closest_holds FROM ({counts}) WHERE review_count > 5 {drawn}",
        "scan_documents": "SELECT * FROM documents",
        "scan_json_reviews": "SELECT doc_id, source AS business_id, text, CAST(coalesce(quality, 0) AS BIGINT) AS useful FROM documents LEFT JOIN labels USING (doc_id)",
        "reviews_of_business": business,
        "reviews_by_sql": business,
        "text_with_label": "SELECT doc_id, text, CAST(quality AS BIGINT) AS label FROM documents JOIN labels USING (doc_id)",
        "business_sample": f"SELECT * FROM ({counts}) WHERE review_count > 15",
        "train_test_split": f"SELECT doc_id, CASE WHEN {train} THEN 'train' ELSE 'test' END AS part FROM documents",
        "random_business": f"SELECT * FROM ({counts}) WHERE review_count > 5 ORDER BY {hash32(chr(34) + 'business_id' + chr(34) + " || ':0'")}, business_id LIMIT 1",
        "random_baseline": "SELECT business_id, doc_id FROM (SELECT source AS business_id, doc_id, row_number() OVER (PARTITION BY source ORDER BY "
        + hash32("CAST(doc_id AS VARCHAR) || ':0'")
        + ", doc_id) AS r FROM documents) WHERE r = 1",
        "row_ids": "SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS row_id FROM documents",
        "tokens": f"SELECT doc_id, CAST(unnest(range(len(l))) AS INTEGER) AS pos, unnest(l) AS token FROM (SELECT doc_id, list_filter({SPLIT}, lambda x: x <> '') AS l FROM documents)",
        "token_counts": with_(counted(), "SELECT token, CAST(sum(n) AS BIGINT) AS n FROM cnt GROUP BY token"),
        "hashed_tf": with_(tf(), "SELECT doc_id, bucket, tf FROM tf"),
        "vocabulary": with_(corpus(), "SELECT row_number() OVER (ORDER BY n DESC, token) - 1 AS word_id, token, n FROM voc"),
        "bag_of_words": with_(corpus(), "SELECT doc_id, token, n FROM bow"),
        "vectorize": with_(counted(), "SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_words FROM cnt GROUP BY doc_id"),
        "document_lengths": with_(corpus(), "SELECT doc_id, length FROM lens"),
        "collection_stats": with_(
            corpus(),
            "SELECT (SELECT count(*) FROM ids) AS documents, CAST((SELECT sum(length) FROM lens) AS BIGINT) AS collection_length, (SELECT count(*) FROM voc) AS alphabet_size",
        ),
        "plsa_init": phi_sql(corpus() + start_phi(), "phi0"),
        "plsa_theta": theta_sql(em(), f"theta{last}"),
        "plsa_phi": phi_sql(em(), f"phi{last}"),
        "plsa_perplexity": with_(em() + [rows(last)], perplexity_of([log_sum(f"rows{i}") for i in range(last + 1)])),
        "doc_loglik": with_(
            em() + [rows(last)],
            f"SELECT ids.doc_id, round(coalesce(sum(n * ln(z)), 0), 4) AS loglik FROM ids LEFT JOIN rows{last} USING (doc_id) GROUP BY ids.doc_id",
        ),
        "plsa_fold_in": theta_sql(folded(), f"xtheta{last}"),
        "robust_theta": theta_sql(robust_em(), f"theta{last}"),
        "robust_phi": phi_sql(robust_em(), f"phi{last}"),
        "robust_background": with_(robust_em(), f"SELECT token, round(bg, {PHI_DIGITS}) AS bg FROM bg{last}"),
        "robust_noise": with_(robust_em(), f"SELECT doc_id, token, round(noise, {THETA_DIGITS}) AS noise FROM noise{last}"),
        "robust_perplexity": with_(
            robust_em() + [robust_rows(last)], perplexity_of([log_sum(f"rows{i}") for i in range(last + 1)])
        ),
        "robust_fold_in": theta_sql(robust_folded(None), f"xtheta{last}"),
        "robust_fold_in_fixed": theta_sql(robust_folded(f"bg{last}"), f"xtheta{last}"),
        "regularized_theta": theta_sql(em(*priors), f"theta{last}"),
        "regularized_phi": phi_sql(em(*priors), f"phi{last}"),
        "regularized_perplexity": with_(em(*priors) + [rows(last)], perplexity_of(regularized_parts)),
        "robust_doc_loglik": with_(
            robust_em() + [robust_rows(last)],
            f"SELECT ids.doc_id, round(coalesce(sum(n * ln(z)), 0), 4) AS loglik FROM ids LEFT JOIN rows{last} USING (doc_id) GROUP BY ids.doc_id",
        ),
        "plsa_fold_in_perplexity": with_(
            folded() + [rows(last, "x", f"phi{last}")], perplexity_of([log_sum(f"xrows{i}") for i in range(last + 1)], new_length)
        ),
        "robust_fold_in_perplexity": with_(
            robust_folded(None) + [robust_rows(last, "x", f"phi{last}")],
            perplexity_of([log_sum(f"xrows{i}") for i in range(last + 1)], new_length),
        ),
        "robust_regularized_theta": theta_sql(robust_em(*priors), f"theta{last}"),
        "robust_regularized_phi": phi_sql(robust_em(*priors), f"phi{last}"),
        "robust_regularized_perplexity": with_(robust_em(*priors) + [robust_rows(last)], perplexity_of(regularized_parts)),
        "custom_prior_phi": phi_sql(em(phi_prior=f"greatest(0.0::DOUBLE, {{c}} - {PUSH} * {{old}} * ({{all}} - {{old}}))"), f"phi{last}"),
        "matrix_prior_phi": phi_sql(em(phi_prior=APART), f"phi{last}"),
        "matrix_prior_perplexity": with_(
            em(phi_prior=APART) + [rows(last)],
            perplexity_of([f"{log_sum(f'rows{i}')} + {overlap_density(i)}" for i in range(last + 1)]),
        ),
        "robust_matrix_prior_phi": phi_sql(robust_em(phi_prior=APART), f"phi{last}"),
        "matrix_prior_theta": theta_sql(em("{c} * (1 - {part})"), f"theta{last}"),
        "dirichlet_log_prior": with_(em(*priors), f"SELECT doc_id, round({THETA_DENSITY}, 4) AS log_prior FROM theta{last}"),
        "phi_log_prior": with_(
            em(*priors), "SELECT " + ", ".join(f"round({phi_density(k, f'phi{last}')}, 4) AS log_prior{k}" for k in KS)
        ),
        "custom_prior_theta": theta_sql(em(f"greatest(0.0::DOUBLE, {{c}} + {PULL} * {{old}})"), f"theta{last}"),
        "center_distances": with_(DISTANCES, "SELECT doc_id, cluster_id, round(distance, 6) AS distance FROM d"),
        "furthest_nth_cluster": nth("PARTITION BY doc_id", "distance DESC, cluster_id", 2),
        "furthest_cluster": nth("PARTITION BY doc_id", "distance DESC, cluster_id", 1),
        "closest_nth_point": nth("PARTITION BY cluster_id", "distance, doc_id", 3),
        "closest_point": nth("PARTITION BY cluster_id", "distance, doc_id", 1),
        "closest_nth_point_to_cluster": nth("", "distance, doc_id", 2, "doc_id, round(distance, 6) AS distance", "cluster_id = 4"),
        "assign_given_centers": nth("PARTITION BY doc_id", "distance, cluster_id", 1),
        "nearest_of_many_centers": many("PARTITION BY doc_id", "round(distance, 6), cluster_id", 1),
        "furthest_nth_of_many_centers": many("PARTITION BY doc_id", "round(distance, 6) DESC, cluster_id", 2),
        "closest_nth_of_many_centers": many("PARTITION BY cluster_id", "round(distance, 6), doc_id", 3),
        "assign_usable_points": nth("PARTITION BY doc_id", "distance, cluster_id", 1, where=USABLE),
        "wssse_usable_points": with_(
            DISTANCES, f"SELECT round(sum(m), 6) AS wssse FROM (SELECT min(distance) AS m FROM d WHERE {USABLE} GROUP BY doc_id)"
        ),
        "scan_broken_json": f"SELECT 'review' AS kind, CASE WHEN doc_id % 5 <> 0 THEN doc_id END AS doc_id, source AS business_id, text, true AS numbered"
        f" FROM documents WHERE doc_id % 7 <> 0 AND doc_id % 11 <> 0"
        f" UNION ALL SELECT 'rejected', NULL, NULL, CASE WHEN doc_id % 7 = 0 THEN substr({JSON_LINE}, 1, 20) ELSE '[' || doc_id || ']' END, false"
        f" FROM documents WHERE doc_id % 7 = 0 OR doc_id % 11 = 0",
        "reviews_without_ids": "SELECT doc_id % 3 <> 0 AS given, count(*) AS n, count(*) AS different,"
        " CASE WHEN doc_id % 3 <> 0 THEN min(doc_id) ELSE any_value(above) END AS least,"
        " CASE WHEN doc_id % 3 <> 0 THEN max(doc_id) ELSE any_value(above) + count(*) - 1 END AS most"
        " FROM documents, (SELECT max(doc_id) + 1 AS above FROM documents WHERE doc_id % 3 <> 0) GROUP BY doc_id % 3 <> 0",
        "wssse_given_centers": with_(
            DISTANCES, "SELECT round(sum(m), 6) AS wssse FROM (SELECT min(distance) AS m FROM d GROUP BY doc_id)"
        ),
        "predict_given_weights": with_(PREDICTED, "SELECT doc_id, prediction FROM shown"),
        "most_useful": with_(PREDICTED, "SELECT doc_id, prediction FROM shown ORDER BY prediction DESC, doc_id LIMIT 10"),
        "most_useful_half": with_(
            PREDICTED,
            "SELECT doc_id, prediction FROM shown ORDER BY prediction DESC, doc_id LIMIT (SELECT count(*) // 2 FROM shown)",
        ),
        "random_fifth": " UNION ALL ".join(
            f"SELECT '{kind}' AS kind, key FROM (SELECT *, row_number() OVER (ORDER BY {hash32("key || ':0'")}, id) AS r, count(*) OVER () AS n FROM ({rows})) WHERE r <= ceil(n / 5)"
            for kind, rows in (
                ("business", f"SELECT business_id AS key, business_id AS id FROM ({counts})"),
                ("review", "SELECT CAST(doc_id AS VARCHAR) AS key, doc_id AS id FROM documents"),
            )
        ),
        "most_useful_per_business": with_(
            PREDICTED,
            "SELECT business_id, doc_id, prediction FROM (SELECT source AS business_id, doc_id, prediction, row_number() OVER (PARTITION BY source ORDER BY prediction DESC, doc_id) AS r FROM shown JOIN documents USING (doc_id)) WHERE r = 1",
        ),
        "rmse_mse": with_(
            PREDICTED,
            "SELECT round(avg((prediction - quality) ** 2), 6) AS mse, round(sqrt(avg((prediction - quality) ** 2)), 6) AS rmse FROM pred JOIN labels USING (doc_id)",
        ),
        "gd_two_steps": gradients(2, STEP),
        "gd_twelve_steps": gradients(ITERATIONS, SHORT_STEP),
    }
