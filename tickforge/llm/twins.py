"""DuckDB SQL for the queries that SQL can express: chat formatting, mixing, the Merkle manifest, fill-in-the-middle."""

from __future__ import annotations

from tickforge.llm import chat, fill_middle, mixing


def chat_sql() -> str:
    """Digests of the turns themselves, and the formatted length by counting marks and escapes."""
    text = "'</s>[INST] ok [/INST]'"
    marks = "|".join(c.replace("[", r"\[").replace("]", r"\]") for c in chat.CONTROLS)

    def escaped(x: str) -> str:
        return f"(2 * length({x}) - length(replace({x}, '\\', '')) + len(regexp_extract_all({x}, '{marks}')))"

    return f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL SELECT -1, 0, 'user', {text} UNION ALL SELECT -1, 1, 'assistant', {text})
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
 CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
 sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
 CAST(sum({escaped('text')} + CASE role WHEN 'assistant' THEN 7 WHEN 'user' THEN 15 WHEN 'system' THEN 15 ELSE 25 + {escaped('role')} END) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id"""


def mixing_sql(rounds: int = 18) -> str:
    """Raking written out round by round, and the level of exhausted cells in closed form."""
    def goals(margin: str, weight: str) -> str:
        return f"""g_{margin} AS (SELECT {margin}, CASE WHEN w IS NULL THEN t / sum(t) OVER () ELSE w / sum(w) OVER () * (1 - coalesce(sum(t) FILTER (w IS NULL) OVER (), 0) / sum(t) OVER ()) END AS goal
 FROM (SELECT {margin}, CAST(sum(tokens) AS DOUBLE) AS t, {weight} AS w FROM cells GROUP BY {margin}))"""

    def given(margin: str, shares: dict[str, float]) -> str:
        return f"CASE {margin} " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in shares.items()) + " END"

    steps, last = [], "r0"
    for k in range(rounds):
        for m in mixing.MARGINS:
            steps.append(f"r{k}_{m} AS MATERIALIZED (SELECT * REPLACE (w * goal_{m} / sum(w) OVER (PARTITION BY {m}) AS w) FROM {last})")
            last = f"r{k}_{m}"
    return f"""WITH d AS MATERIALIZED (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, len(regexp_extract_all(coalesce(text, ''), '{mixing.WORD}')) AS tokens,
 CASE WHEN contains(text, 'Licen') OR contains(text, 'Copyright') THEN 'legal' WHEN contains(text, '@') THEN 'contact' WHEN contains(text, ' | ') THEN 'table'
  WHEN length(coalesce(text, '')) < 400 THEN 'note' ELSE 'prose' END AS topic, source AS _s, lang AS _l FROM documents),
cells AS MATERIALIZED (SELECT source, lang, topic, sum(tokens) AS tokens FROM d GROUP BY ALL HAVING sum(tokens) > 0),
{goals('source', f'pow(sum(tokens), {mixing.TEMPERATURE})')}, {goals('lang', given('lang', mixing.LANGUAGES))}, {goals('topic', given('topic', mixing.TOPICS))},
r0 AS MATERIALIZED (SELECT cells.*, CAST(tokens AS DOUBLE) AS w, g_source.goal AS goal_source, g_lang.goal AS goal_lang, g_topic.goal AS goal_topic
 FROM cells JOIN g_source USING (source) JOIN g_lang USING (lang) JOIN g_topic USING (topic)),
{', '.join(steps)},
ranked AS (SELECT *, w / tokens AS f, coalesce(sum(tokens) OVER (ORDER BY w / tokens DESC, source, lang, topic ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used,
 sum(w) OVER (ORDER BY w / tokens DESC, source, lang, topic ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest, sum(tokens) OVER () AS every FROM {last}),
level AS (SELECT arg_max(({mixing.BUDGET} * every - used) / rest, (f, source, lang, topic)) FILTER (({mixing.BUDGET} * every - used) / rest * f < 1) AS v FROM ranked),
rates AS (SELECT source, lang, topic, least(1.0, f * v) AS p FROM ranked, level)
SELECT doc_id, _s AS source, _l AS lang, topic, CAST(tokens AS BIGINT) AS tokens, round(p, 6) AS probability FROM d JOIN rates USING (source, lang, topic)
WHERE tokens > 0 AND CAST('0x' || substr(md5('{mixing.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) / {float(16 ** 13)} < p"""


def merkle_sql(levels: int = 9) -> str:
    """All levels of all trees written out, the languages' trees and the tree over them by the same rule; enough levels for 8 ** 9 leaves."""
    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(
            f"coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')" for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"

    def grown(name: str, start: str) -> tuple[str, str]:
        """Nodes of every level ``(tree, i, d, m)``, and the way up ``(tree, r, d, proof, fold, many)`` of every leaf, as two lists of CTEs."""
        nodes, ways, last = [f"{name}0 AS MATERIALIZED (SELECT tree, i, d, count(*) OVER (PARTITION BY tree) AS m FROM {start})"], [], f"{name}0"
        way = f"{start}"
        for k in range(1, levels + 1):
            nodes.append(f"""{name}{k}_runs AS MATERIALIZED (SELECT tree, i // 8 AS i, any_value(m) AS m, list(d ORDER BY i) AS kids, string_agg(d, '' ORDER BY i) AS all_kids FROM {last} GROUP BY tree, i // 8),
{name}{k} AS MATERIALIZED (SELECT tree, i, d, count(*) OVER (PARTITION BY tree) AS m FROM (SELECT tree, i, CASE WHEN m > 1 THEN sha256(all_kids) ELSE all_kids END AS d FROM {name}{k}_runs))""")
            last = f"{name}{k}"
            left, right = f"array_to_string(kids[:w.r % 8], '')", f"array_to_string(kids[w.r % 8 + 2:], '')"
            ways.append(f"""{name}{k}_way AS (SELECT w.* REPLACE (w.r // 8 AS r, CASE WHEN n.m > 1 THEN proof || {left} || {right} ELSE proof END AS proof,
  CASE WHEN n.m > 1 THEN sha256({left} || fold || {right}) ELSE fold END AS fold) FROM {way} w JOIN {name}{k}_runs n ON n.tree = w.tree AND n.i = w.r // 8)""")
            way = f"{name}{k}_way"
        return ",\n".join(nodes), ",\n".join(ways)

    # crc32 of a text of ASCII digits, bit by bit
    crc = ("xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda i: ascii(substr(CAST(doc_id AS VARCHAR), i, 1))::BIGINT)),"
           " lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, (x & 1) * 3988292384))), 4294967295::BIGINT)")
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    lang_nodes, lang_ways = grown("a", "leaves")
    top_nodes, top_ways = grown("b", "tops")
    return f"""WITH own AS MATERIALIZED (SELECT doc_id, coalesce('=' || lang, '') AS tree, {leaf('text')} AS d,
 CASE WHEN {crc} % 3 = 0 THEN {leaf(f"translate(text, '{upper}', '{upper.lower()}')")} ELSE {leaf('text')} END AS received FROM documents),
leaves AS MATERIALIZED (SELECT doc_id, tree, d, row_number() OVER w - 1 AS i, row_number() OVER w - 1 AS r, '' AS proof, received AS fold FROM own WINDOW w AS (PARTITION BY tree ORDER BY doc_id NULLS FIRST, d)),
{lang_nodes}, {lang_ways},
tops AS MATERIALIZED (SELECT tree AS of, '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS i, row_number() OVER (ORDER BY tree) - 1 AS r, d, '' AS proof, '' AS fold FROM a{levels}),
{top_nodes},
joined AS MATERIALIZED (SELECT w.doc_id, w.d AS leaf, t.d AS subroot, '' AS tree, t.r, w.proof, w.fold FROM a{levels}_way w JOIN tops t ON t.of = w.tree),
{top_ways.replace('FROM tops w', 'FROM joined w')}
SELECT doc_id, leaf, subroot, n.d AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = n.d AS verified FROM b{levels}_way, b{levels} n"""


def fill_middle_sql() -> str:
    """Both texts put together from parts and digested whole."""
    marks = (fill_middle.PREFIX, fill_middle.SUFFIX, fill_middle.MIDDLE)
    h = ", ".join(f"CAST('0x' || substr(h, {8 * k + 1}, 8) AS BIGINT) AS h{k + 1}" for k in range(4))
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('{fill_middle.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
k AS (SELECT *, {h} FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
 CASE WHEN n = 0 OR {' OR '.join(f"contains(t, '{m}')" for m in marks)} OR h3 % 100 >= {fill_middle.PLAIN_FROM} THEN 'plain' WHEN h4 % 100 < {fill_middle.SPM_BELOW} THEN 'spm' ELSE 'psm' END AS form FROM k),
p AS (SELECT *, '{marks[0]}' || substring(t, 1, a) AS prefix, '{marks[2]}' || substring(t, a + 1, b - a) AS middle, '{marks[1]}' || substring(t, b + 1, n - b) AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN prefix || suffix || middle ELSE suffix || prefix || middle END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""
