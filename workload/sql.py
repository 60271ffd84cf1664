"""The views of ``workload/views.py`` in SQL, as named CTEs."""

from __future__ import annotations

WS = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def norm(x: str) -> str:
    return rf"regexp_replace(' ' || lower({x}) || ' ', '[^\p{{L}}\p{{N}}]+', ' ', 'g')"


def words(x: str) -> str:
    return rf"list_filter(regexp_split_to_array(lower({x}), '[^\p{{L}}\p{{N}}]+'), lambda z: z <> '')"


def strip_iso(x: str) -> str:
    return rf"regexp_replace({x}, '(?i)\s+Ig[AGME][1-4]?$', '')"


def strip_anti(x: str) -> str:
    return rf"regexp_replace({x}, '(?i)^anti[-\s]+', '')"


def antigen(x: str) -> str:
    return f"trim({strip_anti(strip_iso(x))})"


def mode(x: str) -> str:
    return (
        rf"CASE WHEN regexp_matches(trim({x}), '(?i)^anti[-\s]') THEN 'explicit' "
        rf"WHEN regexp_matches({x}, '(?i)\s+Ig[AGME][1-4]?$') THEN 'implied' ELSE 'none' END"
    )


def tokens(x: str) -> str:
    return rf"list_filter(regexp_split_to_array({x}, '[\s/]+'), lambda z: z <> '')"


def k(x: str, prefix: str = "K") -> str:
    return f"printf('{prefix}%06d', {x})"


def cap(x: str) -> str:
    return f"upper(substr({x},1,1)) || substr({x},2)"


CTE: dict[str, tuple[list[str], str]] = {}


def _cte(name: str, body: str, *needs: str) -> None:
    CTE[name] = (list(needs), body)


_W1, _W2 = "split_part(p_name,' ',1)", "split_part(p_name,' ',2)"

_cte("v_forms", f"""
  SELECT p_partkey, CASE p_partkey % 12
    WHEN 0 THEN 'Anti-' || {cap(_W2)} || ' IgG' WHEN 1 THEN p_name || ' IgG4'
    WHEN 2 THEN 'anti ' || {_W1} WHEN 3 THEN 'α-' || {_W1} || 'β' || {_W2} || 'Δκ'
    WHEN 4 THEN {_W1} || {cap(_W2)} WHEN 5 THEN {_W1} || '-' || {_W2}
    WHEN 6 THEN 'ANTI-' || {_W1} || '/' || {_W2} WHEN 7 THEN {_W1} || '   ' || {_W2}
    WHEN 8 THEN 'μ' || {_W1} || 'µ' WHEN 9 THEN '-' WHEN 10 THEN 'anti' || {_W1}
    ELSE {_W1} || ' IgD' END AS t FROM part""")


def _w(i: int) -> str:
    return f"coalesce(w[{i}],'x')"


_cte("v_words", r"""
  SELECT item_id, win, w[9 * win + 1 : 9 * win + 9] AS w FROM (
    SELECT item_id, w, unnest(range(greatest(1, (len(w) + 8) // 9))) AS win FROM (
      SELECT item_id, list_filter(regexp_split_to_array(text, '[^\p{L}\p{N}]+'), lambda z: z <> '') AS w FROM benchmark))""")
_cte("v_terms", f"""
  SELECT (item_id * 1048576 + win) * 8 + f AS term_id,
    CASE f WHEN 0 THEN {_w(1)} || ' ' || {_w(2)} || ' ' || {_w(3)} WHEN 1 THEN 'anti ' || {_w(2)}
      WHEN 2 THEN 'Anti-' || {_w(3)} WHEN 3 THEN {_w(4)} || ' IgG'
      WHEN 4 THEN lower(substr({_w(5)},1,2)) || {cap(_w(6))} WHEN 5 THEN 'src' || item_id
      WHEN 6 THEN {_w(1)} || '-' || {_w(2)} ELSE {_w(3)} || ' ' || {_w(2)} END AS term,
    CASE WHEN f % 4 <> 3 THEN {_w(7)} || ' ' || {_w(8)} END AS "full",
    CASE WHEN f % 4 < 2 THEN {_w(7)} || ' ' || {_w(8)} || '/' || {_w(9)} || ', antibody/anti' || {_w(2)} || '/(anti)' END AS search
  FROM v_words, (SELECT unnest(range(8)) AS f)""", "v_words")

_cte("v_devices", f"""
  SELECT {k('doc_id')} AS k_number,
    split_part(text, chr(10), 1) || CASE WHEN doc_id % 7 = 0 THEN ' antibody' ELSE '' END AS device_name,
    text AS statement_or_summary, source, lang || ' kit' AS kit, source AS applicant,
    CASE quality WHEN 1 THEN 'Substantially Equivalent' WHEN 0 THEN 'Not Substantially Equivalent' END AS decision_description,
    DATE '1995-01-01' + CAST(doc_id % 3650 AS INT) AS decision_date, lang AS panel
  FROM documents LEFT JOIN labels USING (doc_id)""")
_cte("v_texts", f"""
  SELECT *, regexp_matches(f1 || '|' || f2 || '|' || f3, ' (anti|antibody|antibodies|autoantibody|autoantibodies|ab) ') AS has_anti,
    regexp_matches(f1 || '|' || f2 || '|' || f3, ' (antibody|antibodies|autoantibody|autoantibodies) ') AS has_strict
  FROM (SELECT k_number, {norm('device_name')} AS f1, {norm('statement_or_summary')} AS f2,
        {norm('source')} || '|' || {norm('kit')} AS f3 FROM v_devices)""", "v_devices")

_cte("v_parts", f"""
  SELECT *, {tokens('antigen')} AS atk FROM (
    SELECT term_id, term AS t, {mode('term')} AS mode, {antigen('term')} AS antigen,
      {tokens(strip_anti('term'))} AS bt, "full", search FROM v_terms)""", "v_terms")
_cte("v_variants", r"""
  SELECT term_id, v FROM (
    SELECT DISTINCT term_id, antigen, unnest([
      regexp_replace(antigen, '([a-z])([A-Z])', '\1 \2', 'g'), replace(antigen, '-', ' '),
      CASE WHEN contains(antigen, ' ') THEN regexp_replace(antigen, '\s+', '-', 'g') ELSE antigen END,
      regexp_replace(antigen, '[\s-]+', '', 'g')]) AS v FROM v_parts WHERE antigen <> '')
  WHERE v <> antigen""", "v_parts")
_cte("v_groups", r"""
  SELECT term_id, mode, g FROM (
    SELECT term_id, mode, list_filter(regexp_split_to_array(unnest(string_split(coalesce(nullif(search,''), "full"), '/')), '[\s/,()]+'),
      lambda z: z <> '' AND lower(z) NOT IN ('anti','antibody')) AS g FROM v_parts)
  WHERE len(g) > 0""", "v_parts")
_cte("v_clauses", f"""
  SELECT term_id, 1 AS tier, 'any' AS scope, 'none' AS need, [{norm('t')}] AS ph FROM v_parts
  UNION ALL SELECT term_id, 2, 'same', mode, list_transform(bt, lambda z: {norm('z')}) FROM v_parts
    WHERE len(bt) > 0 AND (mode <> 'none' OR len(bt) >= 2)
  UNION ALL SELECT term_id, 3, CASE WHEN len(atk) > 1 THEN 'same' ELSE 'any' END, mode,
      CASE WHEN len(atk) > 1 THEN list_transform(atk, lambda z: {norm('z')}) ELSE [{norm('antigen')}] END FROM v_parts
    WHERE antigen <> '' AND NOT (mode = 'none' AND antigen = t AND len(atk) <= 1)
  UNION ALL SELECT term_id, 4, 'any', 'none', [{norm("'anti' || regexp_replace(atk[1], '[^A-Za-z0-9]', '', 'g')")}] FROM v_parts
    WHERE mode <> 'none' AND len(atk) = 1 AND regexp_replace(atk[1], '[^A-Za-z0-9]', '', 'g') <> ''
  UNION ALL SELECT term_id, 5, 'any', 'none', list_transform({tokens('v')}, lambda z: {norm('z')}) FROM v_variants
  UNION ALL SELECT term_id, 6, 'any', CASE WHEN len(g) = 1 AND lower(g[1]) LIKE 'anti%' THEN 'none' ELSE mode END,
      list_transform(g, lambda z: {norm('z')}) FROM v_groups""", "v_parts", "v_variants", "v_groups")
_cte("v_usable", """
  SELECT *, row_number() OVER () AS cid FROM v_clauses WHERE len(ph) > 0 AND NOT list_contains(ph, ' ')""", "v_clauses")
_cte("v_sat", """
  SELECT term_id, tier, k_number FROM v_usable, v_texts WHERE
    CASE WHEN scope = 'same' THEN
      len(list_filter(ph, lambda z: NOT contains(f1, z))) = 0 OR len(list_filter(ph, lambda z: NOT contains(f2, z))) = 0
        OR len(list_filter(ph, lambda z: NOT contains(f3, z))) = 0
    ELSE len(list_filter(ph, lambda z: NOT (contains(f1, z) OR contains(f2, z) OR contains(f3, z)))) = 0 END
    AND CASE need WHEN 'explicit' THEN has_anti WHEN 'implied' THEN has_strict ELSE TRUE END""", "v_usable", "v_texts")
_cte("v_hits", "SELECT DISTINCT term_id, tier, k_number FROM v_sat", "v_sat")
_cte("v_match", """
  SELECT DISTINCT term_id, k_number, label FROM (
    SELECT h.term_id, h.k_number, ['exact','broad','antigen-only','fused-anti','wordform','expansion'][min(h.tier) OVER (PARTITION BY h.term_id)] AS label
    FROM v_hits h LEFT JOIN (SELECT term_id, min(tier) AS first FROM v_hits WHERE tier <= 3 GROUP BY 1) w USING (term_id)
    WHERE h.tier >= 4 OR h.tier = w.first)""", "v_hits")

_cte("v_sub_devices", f"""
  SELECT {k('o_orderkey')} AS k_number, o_orderpriority || ' ' || o_orderstatus AS device_name, c_name AS applicant,
    CASE o_orderstatus WHEN 'F' THEN 'Substantially Equivalent' WHEN 'O' THEN 'Substantially Equivalent - With Limitations'
      ELSE 'Not Substantially Equivalent' END AS decision_description,
    CAST(o_orderdate AS DATE) AS decision_date,
    CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN substr(o_orderpriority, 3) END AS panel
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey""")
_cte("v_matches", f"""
  SELECT term, k_number, match_mode, CASE match_mode WHEN 'exact' THEN 'confirmed' ELSE 'inferred' END AS confidence,
    CASE match_mode WHEN 'predicate' THEN min(via) END AS via_k_number
  FROM (SELECT p_name AS term, {k('l_orderkey')} AS k_number, {k('l_suppkey')} AS via,
      CASE WHEN l_returnflag = 'R' THEN 'predicate' WHEN l_linenumber >= 6 THEN 'gudid' ELSE 'exact' END AS match_mode
    FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY term, k_number, match_mode""")
_cte("v_sub_terms", "SELECT p_name AS term FROM part UNION SELECT p_brand FROM part")
_cte("v_details", """
  SELECT m.*, d.device_name, d.applicant, d.decision_description, d.decision_date, d.panel
  FROM v_matches m JOIN v_sub_devices d USING (k_number) WHERE m.confidence = 'confirmed'""", "v_matches", "v_sub_devices")
_cte("v_summary", """
  SELECT t.term, count(d.k_number) AS total_submissions,
    count(*) FILTER (WHERE d.decision_description LIKE 'Substantially Equivalent%') AS cleared_count,
    count(DISTINCT d.applicant) AS unique_applicants,
    max(d.decision_date) FILTER (WHERE d.decision_description LIKE 'Substantially Equivalent%') AS latest_approval
  FROM v_sub_terms t LEFT JOIN v_details d USING (term) GROUP BY t.term""", "v_sub_terms", "v_details")

_cte("v_edges", f"SELECT DISTINCT {k('l_orderkey')} AS device_k, {k('l_partkey')} AS predicate_k FROM lineitem")
_cte("v_seeds", f"SELECT s_suppkey AS term_id, {k('s_suppkey')} AS k_number FROM supplier")

_cte("v_lines", """
  SELECT DISTINCT l_orderkey, p_partkey, p_name FROM lineitem JOIN part ON l_partkey = p_partkey""")
_cte("v_first", "SELECT l_orderkey, arg_min(p_name, p_partkey) AS name FROM v_lines GROUP BY 1", "v_lines")
_cte("v_cites", f"""
  SELECT l_orderkey, {k('l_orderkey')} AS device_k, {k('p_partkey % 1000000')} AS predicate_k, p_name AS predicate_name
  FROM v_lines WHERE l_orderkey % 11 <> 3""", "v_lines")
_cte("v_measured", f"""
  SELECT l_orderkey, {k('l_orderkey')} AS k_number,
    CASE WHEN l_orderkey % 11 <> 3 AND l_orderkey % 5 < 4 THEN
      ['Measurand','Analyte','Type of Test or Tests Performed','Intended Use'][l_orderkey % 5 + 1] END AS label,
    CASE WHEN l_orderkey % 11 <> 3 AND l_orderkey % 5 < 4 THEN name || ' assay' END AS value
  FROM v_first""", "v_first")

_cte("v_registry", f"""
  SELECT p_partkey, p_name || ' ' || p_type AS device_description, p_brand AS brand_name, p_size,
    p_size % 5 = 0 OR (p_size % 5 = 3) AS bare,
    CASE WHEN p_size % 5 <> 4 THEN list_filter([CASE WHEN p_partkey < 1000000 THEN {k('p_partkey')} END, CASE WHEN p_size % 7 = 0 THEN {k('p_size', 'DEN')} END],
      lambda z: z IS NOT NULL) ELSE [] END AS numbers
  FROM part""")
_cte("v_reg_terms", f"""
  SELECT min(p_partkey) AS term_id, p_name AS term, CASE WHEN {_W1} <> 'hot' THEN p_name END AS "full",
    CASE WHEN {_W1} IN ('old','hot') THEN NULL WHEN {_W1} = 'new' THEN p_name || '/' || upper(p_name) || '/PROMO ' || {_W2}
      ELSE {_W2} || ' ECONOMY/' || {_W1} || ' Brand#7/ /' || {_W2} || ' ECONOMY' END AS search
  FROM part GROUP BY p_name""")
_cte("v_reg_groups", f"""
  SELECT DISTINCT term_id, list_transform(g, lambda z: {norm('z')}) AS ph FROM (
    SELECT term_id, {tokens('unnest(string_split(coalesce(search, "full"), ' + "'/'" + '))')} AS g FROM v_reg_terms)
  WHERE len(g) > 0""", "v_reg_terms")
_cte("v_reg_hits", f"""
  SELECT DISTINCT term_id, unnest(numbers) AS k_number FROM v_reg_groups,
    (SELECT *, {norm('device_description')} AS f1, {norm('brand_name')} AS f2 FROM v_registry WHERE NOT bare)
  WHERE len(list_filter(ph, lambda z: NOT (contains(f1, z) OR contains(f2, z)))) = 0""", "v_reg_groups", "v_registry")

_KEY = "p_name || ' ' || p_partkey"
_cte("v_model", f"""
  SELECT {_KEY} AS term_key, CASE WHEN p_size <> 50 AND p_partkey % 6 IN (0, 1) THEN p_name END AS "full",
    CASE WHEN p_size <> 50 AND p_partkey % 6 = 0 THEN p_name || '/' || p_type || '/' || p_brand END AS search FROM part""")
_cte("v_terminology", f"""
  SELECT {_KEY} AS term_key, CASE WHEN p_size % 3 = 0 THEN p_name WHEN p_size <= 45 THEN p_brand END AS "full" FROM part""")
_cte("v_cache", f"""
  SELECT {_KEY} AS term_key, CASE WHEN p_size > 4 THEN p_type END AS "full",
    CASE WHEN p_size BETWEEN 5 AND 8 THEN p_type || '/' || p_brand END AS search,
    CASE WHEN p_size <= 4 THEN 'none' ELSE 'umls' END AS source FROM part WHERE p_size <= 12""")
_cte("v_listing", rf"""
  SELECT page_id, url, row_no, facilityName, trim(regexp_replace(analyte, '{WS}+', ' ', 'g')) AS analyte, status, detailLink,
    1000 + page_id % 1000 AS total
  FROM (
    SELECT page_id, url, 0 AS row_no, regexp_extract(url, '//([^/]+)/', 1) AS facilityName, regexp_extract(html, '<title>([^<]*)</title>', 1) AS analyte,
      'Approved' AS status, 'https://www.wadsworth.org' || regexp_extract(html, '<li><a href="(/[^"]*)"', 1) AS detailLink FROM pages
    UNION ALL
    SELECT page_id, url, 1, 'Lab Two', regexp_extract(html, '<h1>([^<]*)</h1>', 1), 'Conditionally Approved',
      'http://x' || regexp_extract(html, '<li><a href="(/[^"]*)"', 1) FROM pages)""")
_cte("v_list_rows", """
  SELECT p_partkey, p_type || ' ' || p_name AS analyte,
    CASE WHEN p_size % 2 = 0 THEN 'Approved' ELSE 'Conditionally Approved' END AS status FROM part""")


def with_views(body: str, *names: str) -> str:
    """``WITH`` the named views and all they need, then the query."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name not in order:
            for need in CTE[name][0]:
                visit(need)
            order.append(name)

    for n in names:
        visit(n)
    parts = ", ".join(f"{n} AS ({CTE[n][1]})" for n in order)
    return f"WITH {parts} {body}" if order else body
