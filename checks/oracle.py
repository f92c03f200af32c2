"""The same queries in SQL for DuckDB, written straight over the base tables.

Each query is assembled from named common table expressions; ``_sql`` adds the ones
a query refers to, in order.
"""

from __future__ import annotations

import re

from checks.spark_queries import FEASIBILITY, LOOSE
from checks.views import VIEWS

# White space, listed again so that the check does not lean on the code it checks.
_WS_CLASS = (
    r"\t\n\x0b\x0c\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
_DIM = 64


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{_WS_CLASS}]+|[{_WS_CLASS}]+$', '', 'g')"


def _between(src: str, start: str, end: str | None) -> str:
    rest = f"substr({src}, strpos({src}, '{start}') + {len(start)})"
    cut = rest
    if end:
        cut = (
            f"CASE WHEN strpos({rest}, '{end}') > 0 "
            f"THEN substr({rest}, 1, strpos({rest}, '{end}') - 1) ELSE {rest} END"
        )
    return f"CASE WHEN strpos({src}, '{start}') = 0 THEN '' ELSE {_strip(cut)} END"


def _number(x: str) -> str:
    digits = f"regexp_matches({_strip(x)}, '^[+-]?[0-9]+([.][0-9]*)?$')"
    return f"CASE WHEN {digits} THEN CAST(trunc(CAST({_strip(x)} AS DOUBLE)) AS BIGINT) END"


def _words(x: str) -> str:
    return f"regexp_extract_all({x}, '[^{_WS_CLASS}]+')"


def _greedy(costs: str, room: str) -> str:
    """Start positions of greedily packed groups, as a fold over the costs."""
    return (
        f"list_reduce({costs}, lambda acc, c: CASE WHEN acc.n = 1 OR acc.used + c > {room} "
        "THEN {'used': c, 'n': acc.n + 1, 'starts': list_append(acc.starts, acc.n)} "
        "ELSE {'used': acc.used + c, 'n': acc.n + 1, 'starts': acc.starts} END, "
        "{'used': 0::BIGINT, 'n': 1::BIGINT, 'starts': []::BIGINT[]}).starts"
    )


def _groups(items: str, starts: str, sep: str) -> str:
    return (
        f"list_transform({starts}, lambda s, i: array_to_string({items}"
        f"[s:coalesce({starts}[i + 1] - 1, len({items}))], '{sep}'))"
    )


def _hashed(name: str, source: str, key: str, text: str) -> dict[str, str]:
    """CTEs giving the sparse unit vector (key, pos, x) of each text."""
    return {
        f"{name}_slots": f"""
            SELECT {key}, CAST(('0x' || substr(md5(t), 1, 4)) AS INT) % {_DIM} AS pos,
                   CAST(count(*) AS DOUBLE) AS n
            FROM (SELECT {key}, unnest(string_split_regex(lower({text}),
                         '[^\\p{{L}}\\p{{N}}]+')) AS t FROM {source})
            WHERE t <> '' GROUP BY ALL""",
        name: f"""
            SELECT {key}, pos, CAST(n / z AS FLOAT) AS x FROM {name}_slots
            JOIN (SELECT {key}, sqrt(sum(n * n)) AS z FROM {name}_slots GROUP BY {key})
            USING ({key})""",
    }


def _split_section(data: str, label: str, limit: int) -> str:
    """Chunk texts of a section as a list; ``packed_*`` columns hold long ones."""
    head = f"concat('Title: ', title, chr(10), '{label}: ')"
    room = f"({limit} - length({head}))"
    starts = _greedy(f"list_transform({_words(data)}, lambda w: length(w) + 1)", room)
    packed = _groups(_words(data), starts, " ")
    return (
        f"CASE WHEN length({head}) + length({data}) <= {limit} THEN [concat({head}, {data})] "
        f"WHEN {room} <= 100 THEN [concat({head}, substr({data}, 1, 100))] "
        f"ELSE list_transform({packed}, lambda p: concat({head}, p)) END"
    )


def _section(data: str, label: str, limit: int) -> str:
    return f"CASE WHEN {data} = '' THEN [] ELSE {_split_section(data, label, limit)} END"


def _outcomes(items: str, label: str, limit: int) -> str:
    head = f"concat('Title: ', title, chr(10), '{label}:', chr(10))"
    lines = f"list_transform({items}, lambda o: concat('  - ', o, chr(10)))"
    room = f"({limit} - length({head}))"
    starts = _greedy(f"list_transform({lines}, lambda x: length(x))", room)
    grouped = _groups(lines, starts, "")
    return (
        f"CASE WHEN len({items}) = 0 THEN [] "
        f"ELSE list_transform({grouped}, lambda p: concat({head}, p)) END"
    )


def _ranked(source: str, k: int, by: str = "query_id", item: str = "chunk_id") -> str:
    return f"""
        SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY score DESC, {item}) AS rank
        FROM {source} QUALIFY rank <= {k}"""


def _dense(queries: str, items: str, item: str = "chunk_id") -> str:
    return f"""
        SELECT q.query_id, c.{item}, round(sum(CAST(q.x AS DOUBLE) * CAST(c.x AS DOUBLE)), 6) AS score
        FROM {queries} q JOIN {items} c USING (pos) GROUP BY ALL"""


def _graded(ratio: str, grades) -> str:
    cases = "".join(f" WHEN {ratio} >= {bound} THEN '{name}'" for bound, name in grades[:-1])
    return f"CASE{cases} ELSE '{grades[-1]}' END"


_LEVELS = [(1.5, "HIGH"), (1.0, "MEDIUM"), "LOW"]
_RISKS = [(2.0, "Minimal"), (1.2, "Moderate"), "High"]


def _feasibility(known: str) -> str:
    """Columns over median_enrollment, patient_limit and eligible."""
    target = "coalesce(nullif(median_enrollment, 0.0), CAST(patient_limit AS DOUBLE))"
    everyone = "coalesce(eligible, 0)"
    kinds = {"capped": f"least({everyone}, patient_limit)", "population": everyone}
    out = [f"CASE WHEN {known} THEN {target} END AS target_enrollment"]
    for kind, n in kinds.items():
        ratio = f"(CASE WHEN {target} > 0 THEN {n} / {target} ELSE 0.0::DOUBLE END)"
        out += [
            f"CASE WHEN {known} THEN CAST({n} AS BIGINT) END AS {kind}_available",
            f"CASE WHEN {known} THEN round({ratio}, 2) END AS {kind}_ratio",
            f"CASE WHEN {known} THEN {_graded(ratio, _LEVELS)} END AS {kind}_level",
            f"CASE WHEN {known} THEN {_graded(ratio, _RISKS)} END AS {kind}_risk",
        ]
    return ", ".join(out)


def _printed(name: str) -> str:
    return (
        f"CASE WHEN n_{name} % 2 = 1 THEN CAST(CAST(median_{name} AS BIGINT) AS VARCHAR) "
        f"ELSE format('{{:.1f}}', median_{name}) END"
    )


def _sentence(matched: str, level: str) -> str:
    target = f"CASE WHEN median_enrollment <> 0 THEN {_printed('enrollment')} END"
    return f"""concat('Found ', n_trials, ' similar trials. Inferred ', len(names),
        ' unique conditions: ', array_to_string(names[1:5], ', '),
        CASE WHEN len(names) > 5 THEN '...' ELSE '' END,
        '. Age range: ', coalesce({_printed('min_age')}, 'None'), '–',
        coalesce({_printed('max_age')}, 'None'),
        '. Target enrollment: ', coalesce({target}, 'N/A'),
        '. Matched ', coalesce({matched}, 0), ' patients (feasibility: ',
        coalesce({level}, 'UNKNOWN'), ').')"""


def _inferred(hits: str) -> dict[str, str]:
    """CTEs from hits (query_id, rank, conditions, ages, enrollment) to criteria."""
    return {
        f"{hits}_names": f"""
            SELECT query_id, list(name ORDER BY r, pos) AS names FROM (
              SELECT query_id, name, min(rank) AS r, arg_min(pos, rank * 1000 + pos) AS pos FROM (
                SELECT query_id, rank, trim(unnest(string_split(conditions, ','))) AS name,
                       generate_subscripts(string_split(conditions, ','), 1) AS pos FROM {hits})
              WHERE name <> '' GROUP BY query_id, name)
            GROUP BY query_id""",
        f"{hits}_criteria": f"""
            SELECT m.*, coalesce(names, []) AS names,
                   least(coalesce(CAST(trunc(median_enrollment) AS BIGINT), 100), 200) AS patient_limit,
                   CAST(trunc(median_min_age) AS INT) AS age_min,
                   CAST(trunc(median_max_age) AS INT) AS age_max
            FROM (SELECT query_id, count(*) AS n_trials, median({_number('minimum_age')}) AS median_min_age,
                         median({_number('maximum_age')}) AS median_max_age,
                         CAST(median(enrollment) AS DOUBLE) AS median_enrollment,
                         count({_number('minimum_age')}) AS n_min_age,
                         count({_number('maximum_age')}) AS n_max_age,
                         count(enrollment) AS n_enrollment
                  FROM {hits} GROUP BY query_id) m
            LEFT JOIN {hits}_names USING (query_id)""",
    }


def _matches(name: str, criteria: str, required: str, threshold: float) -> dict[str, str]:
    """CTEs for (criteria_id, patient_id) with every required name met, any age.

    ``criteria`` has criteria_id; ``required`` is (criteria_id, req) with distinct reqs.
    """
    req = _hashed(f"{name}_rv", f"(SELECT DISTINCT req FROM {required})", "req", "req")
    return req | {
        f"{name}_pairs": f"""
            SELECT r.req, v.key FROM {name}_rv r JOIN vocabulary v USING (pos)
            GROUP BY r.req, v.key
            HAVING round(sum(CAST(r.x AS DOUBLE) * CAST(v.x AS DOUBLE)), 6) >= {threshold}""",
        name: f"""
            SELECT criteria_id, patient_id FROM {required} JOIN {name}_pairs USING (req)
            JOIN patient_conditions ON lower(conditions) = key
            JOIN (SELECT criteria_id, count(*) AS n FROM {required} GROUP BY criteria_id)
              USING (criteria_id)
            GROUP BY criteria_id, patient_id, n HAVING count(DISTINCT req) = n""",
    }


_TRIALS = "nct_id, body AS text, conditions, phase, status, enrollment, minimum_age, maximum_age"

CTES: dict[str, str] = dict(VIEWS)
CTES |= {
    "trials": f"SELECT {_TRIALS} FROM studies",
    "sections_1": f"""
        SELECT nct_id, document,
          {_strip("replace(replace(split_part(document, chr(10), 1), 'Title: ', ''), 'Title:', '')")} AS title,
          {_between('document', 'Eligibility:', 'Conditions:')} AS eligibility,
          {_between('document', 'Conditions:', 'Locations:')} AS conditions,
          {_between('document', 'Locations:', 'Interventions:')} AS locations,
          {_between('document', 'Interventions:', 'Outcomes:')} AS interventions,
          {_between('document', 'Outcomes:', None)} AS outcomes
        FROM studies""",
    "sections": f"""
        SELECT *, {_between('eligibility', 'Inclusion Criteria:', 'Exclusion Criteria:')} AS inclusion,
          {_between('eligibility', 'Exclusion Criteria:', None)} AS exclusion,
          regexp_extract_all(outcomes, '- PRIMARY: ([^\\n]+)', 1) AS primary_outcomes,
          regexp_extract_all(outcomes, '- SECONDARY: ([^\\n]+)', 1) AS secondary_outcomes
        FROM sections_1""",
    "chunk_lists": f"""
        SELECT nct_id, list_concat([concat('Title: ', title, chr(10), 'Conditions: ', conditions)],
          {_section('inclusion', 'Inclusion Criteria', 4096)},
          {_section('exclusion', 'Exclusion Criteria', 4096)},
          {_section('locations', 'Locations', 4096)},
          {_section('interventions', 'Interventions', 4096)},
          {_outcomes('primary_outcomes', 'Primary Outcomes', 4096)},
          {_outcomes('secondary_outcomes', 'Secondary Outcomes', 4096)}) AS parts
        FROM sections""",
    "chunks": """
        SELECT concat(nct_id, '_chunk_', chunk_index) AS chunk_id, nct_id, chunk_index, text FROM (
          SELECT nct_id, CAST(generate_subscripts(parts, 1) - 1 AS INT) AS chunk_index,
                 unnest(parts) AS text FROM chunk_lists)""",
}
CTES |= _hashed("chunk_vectors", "chunks", "chunk_id", "text")
CTES |= _hashed("query_vectors", "queries", "query_id", "query")
CTES |= _hashed("vocabulary", "(SELECT DISTINCT lower(conditions) AS key FROM patient_conditions)", "key", "key")
_TOKENS = "unnest(string_split_regex(lower({0}), '[^\\p{{L}}\\p{{N}}]+'))"
CTES |= {
    "chunk_terms": f"""
        SELECT chunk_id, term, count(*) AS tf, any_value(dl) AS dl FROM (
          SELECT chunk_id, term, count(*) OVER (PARTITION BY chunk_id) AS dl FROM (
            SELECT chunk_id, {_TOKENS.format('text')} AS term FROM chunks) WHERE term <> '')
        GROUP BY chunk_id, term""",
    "corpus": """
        SELECT count(*) AS n, avg(len(list_filter(string_split_regex(lower(text),
               '[^\\p{L}\\p{N}]+'), lambda t: t <> ''))) AS avg_dl FROM chunks""",
    "query_terms": f"""
        SELECT query_id, term, count(*) AS qtf FROM (
          SELECT query_id, {_TOKENS.format('query')} AS term FROM queries) WHERE term <> ''
        GROUP BY ALL""",
    "frequencies": "SELECT term, count(*) AS df FROM chunk_terms GROUP BY term",
    "bm25": """
        SELECT query_id, chunk_id, round(sum(qtf * ln(1.0 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2
               / (tf + 1.2 * (0.25 + 0.75 * dl / avg_dl))), 9) AS score
        FROM query_terms JOIN frequencies USING (term) JOIN chunk_terms USING (term), corpus
        GROUP BY query_id, chunk_id""",
    "dense_scores": _dense("query_vectors", "chunk_vectors"),
    "dense_5": _ranked("dense_scores", 5),
    "dense_10": _ranked("dense_scores", 10),
    "sparse_5": _ranked("bm25", 5),
    "sparse_10": _ranked("bm25", 10),
}


def _fused(a: str, b: str) -> str:
    return f"""
        SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score
        FROM (SELECT query_id, chunk_id, rank FROM {a} UNION ALL
              SELECT query_id, chunk_id, rank FROM {b}) GROUP BY ALL"""


def _best(hits: str, keep: str = "true") -> str:
    return f"""
        SELECT h.query_id, h.chunk_id, t.nct_id, h.rank, h.score, t.phase, t.status, t.enrollment,
               t.minimum_age, t.maximum_age, t.conditions, t.text
        FROM {hits} h JOIN chunks c USING (chunk_id) JOIN trials t USING (nct_id)
        JOIN requests r USING (query_id) WHERE {keep}
        QUALIFY row_number() OVER (PARTITION BY h.query_id, t.nct_id ORDER BY h.rank) = 1"""


def _own_filter(scores: str) -> str:
    return f"""
        SELECT s.* FROM {scores} s JOIN chunks USING (chunk_id) JOIN trials USING (nct_id)
        WHERE (s.query_id % 3 <> 0 OR trials.phase = 'en') AND coalesce(enrollment, 0) >= 7 * s.query_id"""


CTES |= {
    "fused_5_all": _fused("dense_5", "sparse_5"),
    "fused_5": _ranked("fused_5_all", 5),
    "fused_10_all": _fused("dense_10", "sparse_10"),
    "fused_10": _ranked("fused_10_all", 10),
    "requests": """
        SELECT query_id, query, CASE query_id % 3 WHEN 0 THEN 'en' WHEN 1 THEN '' END AS phase,
               CASE WHEN query_id % 3 = 2 THEN 1000 ELSE 0 END AS min_enrollment FROM queries""",
    "filtered_hits": _best(
        "fused_5",
        "(coalesce(r.phase, '') = '' OR t.phase = r.phase) "
        "AND coalesce(t.enrollment, 0) >= r.min_enrollment",
    ),
    "plain_hits": _best("fused_5"),
    # Pre-filter: the legs see French chunks only, the corpus statistics stay whole.
    # Even requests ask for French studies, odd ones for large ones.
    "fr_dense_all": """
        SELECT d.* FROM dense_scores d JOIN chunks USING (chunk_id) JOIN trials USING (nct_id)
        WHERE CASE WHEN d.query_id % 2 = 0 THEN trials.phase = 'fr' ELSE coalesce(enrollment, 0) >= 1000 END""",
    "fr_dense": _ranked("fr_dense_all", 5),
    "fr_sparse_all": """
        SELECT d.* FROM bm25 d JOIN chunks USING (chunk_id) JOIN trials USING (nct_id)
        WHERE CASE WHEN d.query_id % 2 = 0 THEN trials.phase = 'fr' ELSE coalesce(enrollment, 0) >= 1000 END""",
    "fr_sparse": _ranked("fr_sparse_all", 5),
    "fr_fused_all": _fused("fr_dense", "fr_sparse"),
    "fr_fused": _ranked("fr_fused_all", 5),
    "fr_hits": _best("fr_fused"),
    # A filter of its own for every request.
    "own_dense_all": _own_filter("dense_scores"),
    "own_dense": _ranked("own_dense_all", 5),
    "own_sparse_all": _own_filter("bm25"),
    "own_sparse": _ranked("own_sparse_all", 5),
    "own_fused_all": _fused("own_dense", "own_sparse"),
    "own_fused": _ranked("own_fused_all", 5),
    "own_hits": _best("own_fused"),
    # Cells: the nearest label direction of each vector, and the three nearest of each query.
    "cell_of": """
        SELECT chunk_id, query_id AS cell FROM label_scores
        QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY score DESC, query_id) = 1""",
    "centre_pairs": """
        SELECT q.query_id, c.query_id AS cell, round(sum(CAST(q.x AS DOUBLE) * CAST(c.x AS DOUBLE)), 6) AS score
        FROM centres q JOIN centres c USING (pos) GROUP BY ALL""",
    "probes": """
        SELECT query_id, cell FROM centre_pairs
        QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, cell) <= 3""",
    "ann_scores": """
        SELECT s.* FROM label_scores s JOIN cell_of USING (chunk_id)
        JOIN probes p ON p.query_id = s.query_id AND p.cell = cell_of.cell""",
    "ann_10": _ranked("ann_scores", 10),
    # Vectors of the embeddings table and the mean direction of each label.
    "vectors": """
        SELECT vec_id AS chunk_id, label AS nct_id, CAST(generate_subscripts(embedding, 1) - 1 AS INT) AS pos,
               unnest(embedding) AS x FROM embeddings""",
    "centres": """
        SELECT nct_id AS query_id, pos, CAST(round(avg(CAST(x AS DOUBLE)), 6) AS FLOAT) AS x
        FROM vectors GROUP BY nct_id, pos""",
    "turned": "SELECT query_id, 63 - pos AS pos, x FROM centres",
    "label_scores": _dense("centres", "vectors"),
    "turned_scores": _dense("turned", "vectors"),
    "label_20": _ranked("label_scores", 20),
    "turned_20": _ranked("turned_scores", 20),
    "label_50": _ranked("label_scores", 50),
    "label_fused_all": _fused("label_20", "turned_20"),
    # Patient side.
    "owners": "SELECT c_custkey AS patient_id FROM customer WHERE c_acctbal >= 0",
    "gaps": """
        SELECT id, patient_id, CASE WHEN id % 9 <> 0 THEN conditions END AS conditions
        FROM patient_conditions""",
    "criteria": f"""
        SELECT nct_id AS criteria_id, coalesce({_number('minimum_age')}, 0) AS age_min,
               coalesce({_number('maximum_age')}, 150) AS age_max, conditions FROM studies""",
    "criteria_required": """
        SELECT DISTINCT criteria_id, trim(unnest(string_split(conditions, ','))) AS req FROM criteria""",
    "pair_criteria": "SELECT DISTINCT conditions AS criteria_id, conditions FROM studies",
    "pair_required": """
        SELECT DISTINCT criteria_id, trim(unnest(string_split(conditions, ','))) AS req
        FROM pair_criteria""",
    "one_required": "SELECT 0 AS criteria_id, unnest(['hot gizmo', 'small rod']) AS req",
}
CTES |= _matches("study_matches", "criteria", "criteria_required", 0.75)
CTES |= _matches("pair_matches", "pair_criteria", "pair_required", 0.75)
CTES |= _matches("one_matches", "one", "one_required", LOOSE)
CTES |= {
    "study_eligible": """
        SELECT criteria_id, patient_id, gender FROM study_matches JOIN patients USING (patient_id)
        JOIN criteria USING (criteria_id) WHERE age BETWEEN age_min AND age_max""",
    "free_eligible": """
        SELECT criteria_id, patient_id, gender FROM patients
        JOIN criteria ON age BETWEEN age_min AND age_max""",
    "free_counts": "SELECT criteria_id, count(*) AS eligible FROM free_eligible GROUP BY criteria_id",
    "feasible": f"""
        SELECT nct_id, CAST(enrollment AS DOUBLE) AS median_enrollment, minimum_age, eligible,
               least(coalesce(enrollment, 100), 200) AS patient_limit
        FROM studies LEFT JOIN free_counts ON criteria_id = nct_id""",
    "study_hits": """
        SELECT phase AS query_id, doc_id AS rank, conditions, minimum_age, maximum_age, enrollment
        FROM studies""",
}
CTES |= _inferred("study_hits")
CTES |= _inferred("plain_hits")
CTES |= {
    "found_required": """
        SELECT DISTINCT query_id AS criteria_id, unnest(names) AS req FROM plain_hits_criteria""",
}
CTES |= _matches("found_matches", "plain_hits_criteria", "found_required", LOOSE)
CTES |= {
    "found_eligible": """
        SELECT criteria_id, patient_id, age, gender, race, ethnicity, patient_limit
        FROM found_matches JOIN patients USING (patient_id)
        JOIN plain_hits_criteria ON query_id = criteria_id
        WHERE age BETWEEN age_min AND age_max""",
    "found_first": """
        SELECT * FROM found_eligible
        QUALIFY row_number() OVER (PARTITION BY criteria_id ORDER BY patient_id) <= patient_limit""",
    "analysis": f"""
        SELECT q.query_id, coalesce(n_trials, 0) AS n_trials, coalesce(names, []) AS names,
               median_min_age, median_max_age, median_enrollment, n_min_age, n_max_age, n_enrollment,
               coalesce(patient_limit, 100) AS patient_limit, age_min, age_max, eligible,
               patients_age_min, patients_age_max, patients_age_median, patients_age_mean
        FROM queries q LEFT JOIN plain_hits_criteria USING (query_id)
        LEFT JOIN (SELECT criteria_id AS query_id, count(*) AS eligible FROM found_eligible
                   GROUP BY criteria_id) USING (query_id)
        LEFT JOIN (SELECT criteria_id AS query_id, min(age) AS patients_age_min,
                          max(age) AS patients_age_max, median(age) AS patients_age_median,
                          round(avg(age), 1) AS patients_age_mean
                   FROM found_first GROUP BY criteria_id) USING (query_id)""",
    "graded": f"SELECT *, {_feasibility('age_min IS NOT NULL AND age_max IS NOT NULL')} FROM analysis",
}

_LISTED = "SELECT nct_id, CAST(generate_subscripts({0}, 1) - 1 AS INT) AS pos, unnest({0}) AS text FROM sections"
_CRITERIA_COLUMNS = (
    "query_id, n_trials, array_to_string(names, ', ') AS conditions, median_min_age, "
    "median_max_age, median_enrollment, patient_limit"
)
_FEASIBLE_COLUMNS = ", ".join(FEASIBILITY)
_COUNTED = """
    SELECT patient_id, string_agg(concat(conditions, ' x', n), '; ' ORDER BY conditions) AS conditions
    FROM (SELECT patient_id, conditions, count(*) AS n FROM patient_conditions GROUP BY ALL)
    GROUP BY patient_id"""
_CATEGORIES = "\n UNION ALL ".join(
    f"SELECT '{c}' AS dimension, {c} AS value, count(*) AS n FROM patients GROUP BY {c}"
    for c in ("gender", "race", "ethnicity")
)

QUERIES: dict[str, str] = {
    "scan_patients": "SELECT * FROM patients",
    "scan_conditions": "SELECT patient_id, conditions FROM patient_conditions",
    "scan_trials_json": """
        SELECT nct_id, document AS text, conditions, phase, status, enrollment FROM studies""",
    "sink_overwrite": "SELECT * FROM patients",
    "scan_trials_object": """
        SELECT nct_id, document AS text, conditions, phase, status, enrollment FROM studies""",
    "scan_trials_split": """
        SELECT nct_id, document AS text, conditions, phase, status, enrollment FROM studies""",
    "trial_table_numbers": """
        SELECT nct_id, CASE WHEN doc_id % 3 < 2 THEN enrollment END AS enrollment FROM studies""",
    "load_all": """
        SELECT 'demographics' AS table_name, 2 * count(*) AS rows_read, count(*) AS added,
               count(*) AS skipped, 0::BIGINT AS not_found FROM patients
        UNION ALL
        SELECT 'conditions', count(*), count(p.patient_id) FILTER (c.conditions IS NOT NULL),
               count(p.patient_id) FILTER (c.conditions IS NULL), count(*) - count(p.patient_id)
        FROM (SELECT patient_id, conditions FROM gaps UNION ALL SELECT patient_id, conditions FROM gaps
              UNION ALL SELECT -patient_id, conditions FROM gaps) c LEFT JOIN patients p USING (patient_id)
        UNION ALL
        SELECT 'trials', count(*), count(*), 0, 0 FROM studies""",
    "load_all_conditions": """
        SELECT patient_id, conditions
        FROM (SELECT patient_id, conditions FROM gaps UNION ALL SELECT patient_id, conditions FROM gaps
              UNION ALL SELECT -patient_id, conditions FROM gaps)
        WHERE conditions IS NOT NULL AND patient_id IN (SELECT patient_id FROM patients)""",
    "sink_append": "SELECT chunk_id, nct_id, chunk_index, text, 64 AS dim FROM chunks",
    "incremental_new_chunks": """
        SELECT chunk_id, nct_id, chunk_index, text, 64 AS dim FROM chunks WHERE chunk_index > 0""",
    "incremental_stream": "SELECT chunk_id, nct_id, chunk_index, text FROM chunks",
    "dedupe_rows": """
        SELECT DISTINCT * FROM (SELECT * FROM patient_conditions UNION ALL
                                SELECT * FROM patient_conditions)""",
    "pk_keep_first": """
        SELECT * FROM patient_conditions
        QUALIFY row_number() OVER (PARTITION BY patient_id ORDER BY id) = 1""",
    "reject_nulls": """
        SELECT *, CASE WHEN conditions IS NULL THEN 'conditions' END AS missing_columns FROM gaps""",
    "fk_valid": """
        SELECT * FROM patient_conditions WHERE patient_id IN (SELECT patient_id FROM owners)""",
    "fk_orphans": """
        SELECT * FROM patient_conditions WHERE patient_id NOT IN (SELECT patient_id FROM owners)""",
    "load_report": """
        SELECT 'patient_conditions' AS table_name, count(*) AS rows_read,
               count(o.patient_id) FILTER (conditions IS NOT NULL) AS added,
               count(o.patient_id) FILTER (conditions IS NULL) AS skipped,
               count(*) - count(o.patient_id) AS not_found
        FROM gaps LEFT JOIN owners o USING (patient_id)""",
    "surrogate_key": """
        SELECT patient_id, id AS place, conditions, row_number() OVER (ORDER BY place) AS id
        FROM patient_conditions WHERE patient_id IN (SELECT patient_id FROM owners)""",
    "flatten_conditions": "SELECT nct_id, conditions FROM studies",
    "project_metadata": """
        SELECT nct_id, unnest(['phase', 'status', 'minimum_age', 'maximum_age', 'conditions_count',
                               'enrollment']) AS key,
               unnest([phase, status, minimum_age, maximum_age, '2', CAST(enrollment AS VARCHAR)]) AS value
        FROM studies""",
    "sample_exact_k": """
        SELECT nct_id, conditions FROM studies ORDER BY md5(concat('42:', nct_id)), nct_id LIMIT 100""",
    "chunk_summary": """
        SELECT (SELECT count(*) FROM studies) AS documents, count(*) AS chunks,
               round(count(*) / (SELECT count(*) FROM studies), 1) AS chunks_per_document FROM chunks""",
    "reject_empty_docs": "SELECT nct_id, enrollment IS NULL AS is_empty FROM studies",
    "section_title": "SELECT nct_id, title FROM sections",
    "extract_between": f"""
        SELECT nct_id, conditions, outcomes AS to_end, '' AS no_start,
               {_between('document', 'Locations:', 'No such marker')} AS no_end FROM sections""",
    "parse_sections": """
        SELECT nct_id, title, inclusion, exclusion, conditions, locations, interventions FROM sections""",
    "parse_outcomes": f"""
        SELECT *, 'PRIMARY' AS kind FROM ({_LISTED.format('primary_outcomes')}) UNION ALL
        SELECT *, 'SECONDARY' AS kind FROM ({_LISTED.format('secondary_outcomes')})""",
    "parse_outcomes_spacing": """
        SELECT nct_id, primary_outcomes[1] AS primary_items,
               array_to_string(secondary_outcomes, '|') AS secondary_items FROM sections""",
    "chunk_overview": """
        SELECT nct_id, 0 AS pos, concat('Title: ', title, chr(10), 'Conditions: ', conditions) AS text
        FROM sections""",
    "chunk_sections": f"""
        SELECT nct_id, CAST(generate_subscripts(parts, 1) - 1 AS INT) AS pos, unnest(parts) AS text
        FROM (SELECT nct_id, {_section('inclusion', 'Inclusion Criteria', 1000)} AS parts FROM sections)""",
    "pack_words": f"""
        SELECT doc_id, CAST(generate_subscripts(parts, 1) - 1 AS INT) AS pos, unnest(parts) AS text
        FROM (SELECT doc_id, {_groups('ws', _greedy('list_transform(ws, lambda w: length(w) + 1)', '500'), ' ')} AS parts
              FROM (SELECT doc_id, {_words('text')} AS ws FROM documents))""",
    "pack_outcomes": f"""
        SELECT nct_id, CAST(generate_subscripts(parts, 1) - 1 AS INT) AS pos, unnest(parts) AS text
        FROM (SELECT nct_id, {_outcomes('secondary_outcomes', 'Secondary Outcomes', 85)} AS parts
              FROM sections)""",
    "chunk_documents": "SELECT chunk_id, nct_id, chunk_index, text FROM chunks",
    "embed_text": "SELECT doc_id, pos, round(CAST(x AS DOUBLE), 6) AS x FROM document_vectors",
    "normalize_key": "SELECT id, lower(conditions) AS key FROM patient_conditions",
    "embed_cached": "SELECT key, pos, round(CAST(x AS DOUBLE), 6) AS x FROM vocabulary",
    "embed_distinct": "SELECT key, pos, round(CAST(x AS DOUBLE), 6) AS x FROM vocabulary",
    "l2_normalize": """
        SELECT chunk_id AS vec_id, pos, round(x3 / sqrt(sum(x3 * x3) OVER (PARTITION BY chunk_id)), 6) AS x
        FROM (SELECT chunk_id, pos, CAST(x AS DOUBLE) * 3 AS x3 FROM vectors)""",
    "cosine_similarity": """
        SELECT a.vec_id, round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6)
               AS similarity
        FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
    "embed_quarantine": """
        SELECT doc_id, CASE WHEN length(text) <= 8000 THEN length(text) END::INT AS length,
               CASE WHEN length(text) > 8000 THEN 'ValueError: text too long for the model' END AS error
        FROM documents""",
    "index_quarantine": """
        SELECT chunk_id, length(text) > 1500 AS rejected, count(*) OVER () AS counted FROM chunks""",
    "dense_topk": "SELECT query_id, chunk_id, score, rank FROM label_20 WHERE rank <= 10",
    "bm25_postings": f"""
        SELECT term, chunk_id, count(*) AS tf, any_value(dl) AS dl FROM (
          SELECT chunk_id, term, count(*) OVER (PARTITION BY chunk_id) AS dl FROM (
            SELECT doc_id AS chunk_id, {_TOKENS.format('text')} AS term FROM documents) WHERE term <> '')
        GROUP BY chunk_id, term""",
    "bm25_topk": "SELECT query_id, chunk_id, score, rank FROM sparse_10",
    "rrf_fuse": f"""
        SELECT query_id, chunk_id, score, rank FROM ({_ranked('label_fused_all', 20)})""",
    "hybrid_search": "SELECT query_id, chunk_id, score, rank FROM fused_10",
    "ann_topk": "SELECT query_id, chunk_id, score, rank FROM ann_10",
    "ann_recall": """
        SELECT query_id, count(*) AS k, count(a.chunk_id) AS found, round(count(a.chunk_id) / count(*), 4) AS recall
        FROM (SELECT query_id, chunk_id FROM label_20 WHERE rank <= 10) e
        LEFT JOIN ann_10 a USING (query_id, chunk_id) GROUP BY query_id""",
    "ann_rows_scored": """
        SELECT query_id, count(*) AS rows_scored, (SELECT count(*) FROM cell_of) AS rows_all
        FROM probes JOIN cell_of USING (cell) GROUP BY query_id""",
    "incremental_index": "SELECT query_id, chunk_id, score, rank FROM fused_10",
    "index_after_updates": "SELECT query_id, chunk_id, score, rank FROM fused_10",
    "bm25_from_postings": "SELECT query_id, chunk_id, score, rank FROM sparse_10",
    "filter_phase_status": """
        SELECT nct_id, phase, status FROM trials WHERE phase = 'en' AND status = 'src5'""",
    "filter_min_enrollment": """
        SELECT nct_id, enrollment FROM trials WHERE coalesce(enrollment, 0) >= 1000""",
    "best_chunk_per_trial": """
        SELECT query_id, nct_id, chunk_id, rank FROM label_50
        JOIN (SELECT DISTINCT chunk_id, nct_id FROM vectors) USING (chunk_id)
        QUALIFY row_number() OVER (PARTITION BY query_id, nct_id ORDER BY rank) = 1""",
    "enrich_trials": """
        SELECT query_id, chunk_id, t.nct_id, t.text AS full_text, conditions, false AS missing_trial
        FROM sparse_5 JOIN chunks USING (chunk_id) JOIN trials t ON t.nct_id = chunks.nct_id""",
    "search_trials": """
        SELECT query_id, nct_id, chunk_id, rank, round(score, 3) AS chunk_similarity_score, phase,
               enrollment, conditions, length(text) AS full_text_length FROM filtered_hits""",
    "search_trials_prefiltered": "SELECT query_id, nct_id, rank, phase FROM fr_hits",
    "search_own_filters": "SELECT query_id, nct_id, rank, phase, enrollment FROM own_hits",
    "search_summary": """
        SELECT query_id, r.phase, CAST(r.min_enrollment AS BIGINT) AS min_enrollment,
               count(h.nct_id) AS count
        FROM requests r LEFT JOIN filtered_hits h USING (query_id) GROUP BY ALL""",
    "age_range": "SELECT patient_id, age FROM patients WHERE age BETWEEN 40 AND 70",
    "candidate_conditions": """
        SELECT * FROM patient_conditions
        WHERE patient_id IN (SELECT patient_id FROM patients WHERE age BETWEEN 40 AND 70)""",
    "group_conditions": f"SELECT *, 0 AS page FROM ({_COUNTED})",
    "semantic_pairs": f"""
        SELECT r.req AS req_key, v.key AS cond_key,
               round(sum(CAST(r.x AS DOUBLE) * CAST(v.x AS DOUBLE)), 6) AS similarity
        FROM study_matches_rv r JOIN vocabulary v USING (pos) GROUP BY ALL HAVING similarity >= {LOOSE}""",
    "match_all_conditions": "SELECT criteria_id, patient_id FROM pair_matches",
    "match_any_condition": """
        SELECT DISTINCT split_part(r.key, ' ', 1) AS criteria_id, patient_id
        FROM (SELECT DISTINCT p_name AS key FROM part) r
        JOIN (SELECT a.key, b.key AS cond FROM part_vectors a JOIN vocabulary b USING (pos)
              GROUP BY ALL HAVING round(sum(CAST(a.x AS DOUBLE) * CAST(b.x AS DOUBLE)), 6) >= 0.75)
          USING (key)
        JOIN patient_conditions ON lower(conditions) = cond
        JOIN patients USING (patient_id) WHERE age BETWEEN 40 AND 70""",
    "find_eligible_patients": f"""
        SELECT patient_id, age, gender, race, ethnicity, name, conditions, 0 AS page
        FROM (SELECT * FROM one_matches JOIN patients USING (patient_id)
              WHERE age BETWEEN 40 AND 70 ORDER BY patient_id LIMIT 100)
        JOIN ({_COUNTED}) USING (patient_id)""",
    "match_cohorts": """
        SELECT criteria_id, patient_id,
               row_number() OVER (PARTITION BY criteria_id ORDER BY patient_id) AS rank,
               count(*) OVER (PARTITION BY criteria_id) AS eligible
        FROM study_eligible QUALIFY rank <= 10""",
    "match_cohorts_by_age_only": """
        SELECT criteria_id, patient_id, count(*) OVER (PARTITION BY criteria_id) AS eligible
        FROM free_eligible
        QUALIFY row_number() OVER (PARTITION BY criteria_id ORDER BY patient_id) <= 10""",
    "filter_gender": """
        SELECT criteria_id, count(*) AS eligible FROM study_eligible WHERE gender = 'F'
        GROUP BY criteria_id""",
    "demographics_age": """
        SELECT race, count(*) AS total, min(age) AS age_min, max(age) AS age_max,
               median(age) AS age_median, round(avg(age), 1) AS age_mean FROM patients GROUP BY race""",
    "demographics_counts": _CATEGORIES,
    "demographics_grouping_sets": _CATEGORIES,
    "parse_conditions": """
        SELECT nct_id, CAST(generate_subscripts(names, 1) - 1 AS INT) AS pos, unnest(names) AS text
        FROM (SELECT nct_id, string_split(conditions, ', ') AS names FROM studies)""",
    "unique_conditions": """
        SELECT query_id, array_to_string(names, ', ') AS conditions FROM study_hits_names""",
    "lenient_int": f"""
        SELECT nct_id, {_number('minimum_age')} AS min_age,
               CASE WHEN maximum_age = '' THEN 0 ELSE CAST(maximum_age AS BIGINT) END AS max_age
        FROM studies""",
    "infer_criteria": f"SELECT {_CRITERIA_COLUMNS}, age_min, age_max FROM study_hits_criteria",
    "feasibility": f"SELECT nct_id, {_feasibility('true')} FROM feasible",
    "feasibility_unknown_age": f"""
        SELECT nct_id, {_feasibility(f"({_number('minimum_age')}) IS NOT NULL")} FROM feasible""",
    "analysis_summary": f"""
        SELECT query_id, {_sentence('7', 'NULL')} AS content FROM study_hits_criteria""",
    "analyze_and_match": f"""
        SELECT {_CRITERIA_COLUMNS}, patients_age_min, patients_age_max, patients_age_median,
               patients_age_mean, target_enrollment, {_FEASIBLE_COLUMNS},
               {_sentence('capped_available', 'capped_level')} AS content FROM graded""",
    "analyze_demographics": "\n UNION ALL ".join(
        f"SELECT criteria_id, '{c}' AS dimension, {c} AS value, count(*) AS n FROM found_first "
        f"GROUP BY criteria_id, {c}"
        for c in ("gender", "race", "ethnicity")
    ),
    "lookup_patient": "SELECT * FROM patients WHERE patient_id = 42",
    "conditions_of_patient": "SELECT conditions FROM patient_conditions WHERE patient_id = 42",
    "trials_like": "SELECT nct_id, conditions FROM trials WHERE conditions LIKE '%gizmo%'",
    "patients_left_join": """
        SELECT p.patient_id, p.name, p.age, c.conditions FROM patients p
        LEFT JOIN patient_conditions c ON p.patient_id = CASE WHEN c.patient_id % 10 = 0
          THEN -c.patient_id ELSE c.patient_id END""",
    "patient_with_conditions": """
        SELECT patient_id, name, age, conditions FROM patients JOIN patient_conditions USING (patient_id)""",
    "filter_limit_offset": """
        SELECT patient_id, name, age FROM patients WHERE gender = 'F'
        ORDER BY patient_id LIMIT 5 OFFSET 10""",
    "trials_by_ids": """
        SELECT nct_id, conditions, length(text) AS text_length FROM trials
        WHERE nct_id IN (SELECT concat('NCT', item_id) FROM benchmark)""",
}

CTES |= _hashed("document_vectors", "documents", "doc_id", "text")
CTES |= _hashed("part_vectors", "(SELECT DISTINCT p_name AS key FROM part)", "key", "key")


def _used(sql: str) -> set[str]:
    return set(re.findall(r"[a-z_0-9]+", sql)) & set(CTES)


def _sql(body: str) -> str:
    """``body`` behind a WITH clause of every expression it needs."""
    ordered: list[str] = []

    def add(name: str) -> None:
        if name in ordered:
            return
        for other in sorted(_used(CTES[name]) - {name}):
            add(other)
        ordered.append(name)

    for name in sorted(_used(body)):
        add(name)
    if not ordered:
        return body
    listed = ",\n".join(f"{name} AS MATERIALIZED ({CTES[name]})" for name in ordered)
    return f"WITH {listed}\n{body}"


def oracle_queries() -> dict[str, str]:
    return {name: _sql(body) for name, body in QUERIES.items()}
