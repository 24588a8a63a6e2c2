"""The same results as plain SQL over the same tables, for checking."""

from __future__ import annotations

from rankloom.functions.words import ENGLISH_STOP_WORDS, VECTORIZER_STOP_WORDS
from rankloom.operators.lemmas import SUFFIX_RULES
from rankloom.operators.ranking import MESSAGE_ALL, MESSAGE_FEWER, MESSAGE_TOP
from rankloom.registry.queries import TOKENIZER, TOKENIZER_END, TOKENIZER_START

SPACE = r"[\s\x0b\x1c-\x1f]+"
UNICODE_SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
LETTERS = r"[\p{L}\p{N}_]{2,}"


def words(items) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in items) + "]"


CLEANING_WORDS, VECTORIZER_WORDS = words(ENGLISH_STOP_WORDS), words(VECTORIZER_STOP_WORDS)


def clean_list(col: str, numbers: bool = True, stops: bool = True) -> str:
    text = f"regexp_replace(strip_accents(replace(lower(coalesce({col}, '')), chr(160), ' ')), '[^\\x00-\\x7F]', '', 'g')"
    text = f"regexp_replace(replace({text}, '/', ' '), '[!-/:-@\\[-`{{-~]', '', 'g')"
    if numbers:
        text = f"regexp_replace({text}, '[0-9]+', '', 'g')"
    split = f"regexp_split_to_array({text}, '{SPACE}')"
    stop = f" AND NOT list_contains({CLEANING_WORDS}, w)" if stops else ""
    return f"list_filter({split}, lambda w: w <> ''{stop})"


def clean(col: str, numbers: bool = True, stops: bool = True) -> str:
    return f"array_to_string({clean_list(col, numbers, stops)}, ' ')"


def token_list(text: str, stops: str | None = None) -> str:
    found = f"regexp_extract_all(lower({text}), '{LETTERS}')"
    return f"list_filter({found}, lambda t: NOT list_contains({stops}, t))" if stops else found


def tokens_cte(name: str, source: str, key: str, stops: str | None = VECTORIZER_WORDS, lemmas: bool = False) -> str:
    if lemmas:
        return (f"{lemma_cte(name + 'x', source, key)}, {name} AS MATERIALIZED (SELECT id, "
                f"{token_list('text_cleaned', stops)} AS toks FROM {name}x)")
    return f"{name} AS MATERIALIZED (SELECT {key} AS id, {token_list(clean('text'), stops)} AS toks FROM {source})"


def lemma_cte(name: str, source: str, key: str) -> str:
    """Cleaned texts with every word as a noun's lemma; needs the table lexicon."""
    return (f"{name} AS MATERIALIZED (SELECT id, string_agg(coalesce(x.lemma, w), ' ' ORDER BY p) AS text_cleaned FROM "
            f"(SELECT id, unnest(l) AS w, unnest(generate_series(0, len(l) - 1)) AS p FROM "
            f"(SELECT {key} AS id, string_split({clean('text')}, ' ') AS l FROM {source})) "
            "LEFT JOIN (SELECT word, lemma FROM lexicon WHERE pos = 'noun') x ON x.word = w GROUP BY id)")


def gram_list(high: int = 2) -> str:
    if high == 1:
        return "toks"
    return ("list_concat(toks, list_transform(generate_series(1, len(toks) - 1), "
            "lambda i: toks[i] || ' ' || toks[i + 1]))")


def counts_cte(name: str, tokens: str, high: int = 2) -> str:
    return (f"{name} AS MATERIALIZED (SELECT id, term, count(*) AS tf FROM "
            f"(SELECT id, unnest({gram_list(high)}) AS term FROM {tokens}) GROUP BY ALL)")


def vocab_cte(counts: str, n_docs: str, max_features: int, min_df: int, max_df: float = 0.85) -> str:
    return (f"vocab AS MATERIALIZED (SELECT term, df, tf, "
            f"ln((1.0::DOUBLE + {n_docs}) / (1.0::DOUBLE + df)) + 1.0::DOUBLE AS idf FROM "
            f"(SELECT term, count(*) AS df, sum(tf)::BIGINT AS tf FROM {counts} GROUP BY term) "
            f"WHERE df >= {min_df} AND df <= {max_df}::DOUBLE * {n_docs} "
            f"ORDER BY tf DESC, term LIMIT {max_features})")


def weights_cte(name: str, counts: str, sublinear: bool) -> str:
    tf = "(1.0::DOUBLE + ln(c.tf::DOUBLE))" if sublinear else "c.tf::DOUBLE"
    return (f"{name} AS MATERIALIZED (SELECT id, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY id)) AS w FROM "
            f"(SELECT c.id, c.term, {tf} * v.idf AS raw FROM {counts} c JOIN vocab v USING (term)))")


def both_sides(preset: str, lemmas: bool = False) -> str:
    """Weights of documents (dw) and benchmark items (qw) over one vocabulary fitted on both."""
    cap, min_df, sub = {"base": (5000, 3, False), "combined": (40000, 5, True)}[preset]
    return ", ".join([
        tokens_cte("dt", "documents", "doc_id", lemmas=lemmas), tokens_cte("qt", "benchmark", "item_id", lemmas=lemmas),
        counts_cte("dc", "dt"), counts_cte("qc", "qt"),
        "ac AS (SELECT 'd' || id AS id, term, tf FROM dc UNION ALL SELECT 'q' || id, term, tf FROM qc)",
        vocab_cte("ac", "((SELECT count(*) FROM documents) + (SELECT count(*) FROM benchmark))", cap, min_df),
        weights_cte("dw", "dc", sub), weights_cte("qw", "qc", sub)])


# Every pair, 0 without a common term.
GRID = ("hits AS (SELECT q.id AS qid, d.id AS did, sum(q.w * d.w) AS s FROM qw q JOIN dw d USING (term) GROUP BY ALL), "
        "grid AS MATERIALIZED (SELECT b.item_id, x.doc_id, round(coalesce(h.s, 0), 9) AS score "
        "FROM benchmark b CROSS JOIN documents x "
        "LEFT JOIN hits h ON h.qid = b.item_id AND h.did = x.doc_id)")
RANKED = ("ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank "
          "FROM grid)")
REQUESTED = ("asked AS (SELECT doc_id, doc_id % (SELECT count(*) FROM benchmark) AS item_id FROM documents), "
             "hits AS (SELECT a.item_id, a.doc_id, sum(q.w * d.w) AS s FROM asked a JOIN dw d ON d.id = a.doc_id "
             "JOIN qw q ON q.id = a.item_id AND q.term = d.term GROUP BY ALL), "
             "grid AS (SELECT a.item_id, a.doc_id, round(coalesce(h.s, 0), 9) AS score FROM asked a "
             "LEFT JOIN hits h USING (item_id, doc_id))")

FIT_DOCUMENTS = ", ".join([tokens_cte("dt", "documents", "doc_id"), counts_cte("dc", "dt")])
N_DOCUMENTS = "(SELECT count(*) FROM documents)"
CLEANED = f"cleaned AS MATERIALIZED (SELECT doc_id, lang, {clean('text')} AS text_cleaned FROM documents)"
WORDS = (f"{CLEANED}, counts AS (SELECT word, count(*) AS cnt FROM (SELECT "
         "unnest(string_split(text_cleaned, ' ')) AS word FROM cleaned) WHERE word <> '' GROUP BY word)")
DENSE = ("pairs AS (SELECT a.vec_id AS query_id, b.vec_id, b.label::VARCHAR AS title, "
         "round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS score "
         "FROM embeddings a CROSS JOIN embeddings b), "
         "ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs)")


def _message(message: str, *values: str) -> str:
    parts = message.split("%s")
    out = f"'{parts[0]}'"
    for value, part in zip(values, parts[1:]):
        out += f" || {value} || '{part}'"
    return out


def _lexicon() -> str:
    rules = " UNION ALL ".join(
        f"SELECT word, '{pos}' AS pos, left(word, len(word) - {len(suffix)}) || '{ending}' AS lemma FROM counts "
        f"WHERE word LIKE '%{suffix}' AND len(word) > {len(suffix)}" for pos, suffix, ending in SUFFIX_RULES)
    return (f"{WORDS}, proposed AS ({rules}), lexicon AS MATERIALIZED (SELECT word, pos, lemma FROM "
            "(SELECT p.*, row_number() OVER (PARTITION BY p.word, p.pos ORDER BY c.cnt DESC, p.lemma) AS n "
            "FROM proposed p JOIN counts c ON c.word = p.lemma) WHERE n = 1)")


def _draw(purpose: str) -> str:
    return f"('0x' || left(md5(doc_id::VARCHAR || ':' || pos::VARCHAR || ':{purpose}42'), 7))::BIGINT"


def _mask(source: str = "documents", length: int = 256) -> str:
    top = 1 << 28
    chosen, action = f"({_draw('select')} < {int(0.15 * top)})", _draw("action")
    stats = ", ".join([tokens_cte("dt", source, "doc_id", None), counts_cte("dc", "dt", 1),
                       vocab_cte("dc", f"(SELECT count(*) FROM {source})", 5000, 3)])
    return (f"WITH {stats}, numbered AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS n FROM vocab), "
            f"tok AS (SELECT id AS doc_id, unnest(toks[1:{length}]) AS word, "
            f"unnest(generate_series(0, least(len(toks), {length}) - 1)) AS pos FROM dt), "
            f"drawn AS (SELECT *, {chosen} AS chosen, {action} AS action, "
            f"{_draw('word')} % (SELECT count(*) FROM vocab) AS draw FROM tok) "
            f"SELECT doc_id, pos, CASE WHEN chosen AND action < {int(0.8 * top)} THEN '[MASK]' "
            f"WHEN chosen AND action < {int(0.9 * top)} THEN n.term ELSE word END AS token, "
            "CASE WHEN chosen THEN word END AS label FROM drawn LEFT JOIN numbered n ON n.n = drawn.draw")


def _positions(list_sql: str) -> str:
    return (f"SELECT doc_id, pos, token FROM (SELECT doc_id, unnest(l) AS token, "
            f"unnest(generate_series(0, len(l) - 1)) AS pos FROM (SELECT doc_id, {list_sql} AS l FROM documents))")


def _report() -> str:
    """All tables of the exploratory report below one another."""
    ctes, parts = [], []
    for side, source in (("resume", "benchmark"), ("job", "documents")):
        title = "lang" if side == "job" else "NULL"
        ctes.append(
            f"{side}_t AS MATERIALIZED (SELECT {title} AS title, {clean_list('text')} AS l, len({clean_list('text')}) AS n FROM {source}), "
            f"{side}_w AS MATERIALIZED (SELECT word, count(*) AS cnt FROM (SELECT unnest(l) AS word FROM {side}_t) GROUP BY word), "
            f"{side}_e AS (SELECT CASE WHEN min(n) = max(n) THEN min(n) - 0.5 ELSE min(n) END::DOUBLE AS lo, "
            f"CASE WHEN min(n) = max(n) THEN max(n) + 0.5 ELSE max(n) END::DOUBLE AS hi FROM {side}_t), "
            f"{side}_b AS (SELECT least(floor((n - lo) / ((hi - lo) / 30)), 29)::BIGINT AS bin, count(*) AS cnt FROM {side}_t, {side}_e GROUP BY 1)")
        parts.append(
            f"SELECT '{side}_word_frequency' AS section, word AS label, cnt::DOUBLE AS value FROM (SELECT * FROM {side}_w "
            f"ORDER BY cnt DESC, word LIMIT 30) UNION ALL SELECT '{side}_word_weights', word, "
            f"round(cnt / (SELECT max(cnt) FROM {side}_w), 9) FROM {side}_w UNION ALL SELECT '{side}_lengths', r.bin::VARCHAR, "
            f"coalesce(cnt, 0)::DOUBLE FROM range(30) r(bin) LEFT JOIN {side}_b USING (bin)")
    similar = (
        "first AS (SELECT item_id, text FROM benchmark ORDER BY item_id LIMIT 100), "
        f"{tokens_cte('dt', 'first', 'item_id', None)}, {counts_cte('dc', 'dt', 1)}, "
        f"{vocab_cte('dc', '(SELECT count(*) FROM first)', 100, 1, 1.0)}, {weights_cte('dw', 'dc', False)}, "
        "s AS (SELECT a.id AS doc_a, b.id AS doc_b, sum(a.w * b.w) AS s FROM dw a JOIN dw b USING (term) GROUP BY ALL)")
    top = ("top AS (SELECT title FROM job_t WHERE title IS NOT NULL GROUP BY title ORDER BY count(*) DESC, title LIMIT 5), "
           f"tw AS (SELECT title, word, count(*) AS cnt FROM (SELECT title, unnest({token_list('array_to_string(l, $$ $$)')}) AS word "
           "FROM job_t WHERE title IN (SELECT title FROM top)) GROUP BY ALL)")
    return (f"WITH {', '.join(ctes)}, {similar}, {top} {' UNION ALL '.join(parts)} UNION ALL "
            "SELECT 'resume_similarity', a.item_id || ' ' || b.item_id, round(coalesce(s.s, 0), 9) FROM first a CROSS JOIN first b "
            "LEFT JOIN s ON s.doc_a = a.item_id AND s.doc_b = b.item_id UNION ALL SELECT 'job_top_words', title || ' ' || word, "
            "cnt::DOUBLE FROM (SELECT *, row_number() OVER (PARTITION BY title ORDER BY cnt DESC, word) AS rank FROM tw) WHERE rank <= 10")


def _subwords() -> str:
    """Longest pieces from left to right; a word with a place where none fits, or over 100 characters, is the end mark."""
    mark = lambda name: f"(SELECT piece_id FROM marks WHERE piece = '{name}')"
    return (
        f"WITH RECURSIVE {tokens_cte('dt', 'documents', 'doc_id', None)}, "
        "pieces AS MATERIALIZED (SELECT e.key AS piece, e.value AS piece_id FROM (SELECT unnest(map_entries(from_json("
        f"content::JSON->'model'->'vocab', '\"MAP(VARCHAR, INTEGER)\"'))) AS e FROM read_text('{TOKENIZER}'))), "
        "marks AS MATERIALIZED (SELECT m->>'content' AS piece, (m->>'id')::INTEGER AS piece_id FROM (SELECT "
        f"unnest((content::JSON->'added_tokens')::JSON[]) AS m FROM read_text('{TOKENIZER}'))), "
        "words AS MATERIALIZED (SELECT DISTINCT unnest(toks) AS w FROM dt), "
        "places AS (SELECT w, unnest(range(1, len(w) + 1)) AS s FROM words WHERE len(w) <= 100), "
        "parts AS (SELECT w, s, unnest(range(1, len(w) - s + 2)) AS n FROM places), "
        "best AS MATERIALIZED (SELECT w, s, max(n) AS n, arg_max(piece_id, n) AS piece_id FROM parts JOIN pieces "
        "ON piece = substr(w, s, n) || CASE WHEN s + n > len(w) THEN '</w>' ELSE '' END GROUP BY w, s), "
        "walk AS (SELECT w, 1::BIGINT AS s, []::INTEGER[] AS ids FROM words UNION ALL SELECT w, s + n, ids || [piece_id] FROM walk "
        "JOIN best USING (w, s)), "
        "whole AS (SELECT w, ids FROM walk WHERE s > len(w) AND len(w) <= 100), "
        f"cut AS MATERIALIZED (SELECT w, coalesce(ids, [{mark(TOKENIZER_END)}]) AS ids FROM words LEFT JOIN whole USING (w)), "
        "texts AS (SELECT id, coalesce(flatten(list(ids ORDER BY p) FILTER (w IS NOT NULL)), []) AS ids FROM (SELECT id, "
        "unnest(CASE WHEN len(toks) > 0 THEN toks ELSE [NULL] END) AS w, unnest(range(greatest(len(toks), 1))) AS p FROM dt) "
        "LEFT JOIN cut USING (w) GROUP BY id), "
        f"framed AS (SELECT id, len(ids) AS n_pieces, [{mark(TOKENIZER_START)}] || ids[1:254] || [{mark(TOKENIZER_END)}] AS ids FROM texts) "
        f"SELECT id AS doc_id, n_pieces, pos, coalesce(ids[pos + 1], {mark(TOKENIZER_END)})::BIGINT AS id, "
        "(pos < len(ids))::BIGINT AS mask FROM framed CROSS JOIN range(256) r(pos)")


def _domain_vectors(dim: int = 64, rounds: int = 2) -> str:
    """Unit vectors ``dv`` and ``qv`` of both sides: words take their neighbours' vectors, times positive information, in rounds."""
    listed = lambda part, join=", ": join.join(part.format(i=i) for i in range(dim))
    signs = ", ".join(f"2.0::DOUBLE * ((('0x' || substr(md5(word), {1 + i // 4}, 1))::INT >> {3 - i % 4}) & 1) - 1 AS x{i}"
                      for i in range(dim))
    norm = f"sqrt({listed('x{i} * x{i}', ' + ')})"
    unit = listed("x{i} / " + f"nullif({norm}, 0)" + " AS x{i}")
    steps = ", ".join(f"s{k} AS (SELECT a AS word, {listed('sum(v * x{i}) AS x{i}')} FROM m JOIN e{k - 1} e ON e.word = m.b GROUP BY a), "
                      f"e{k} AS MATERIALIZED (SELECT word, {unit} FROM s{k})" for k in range(1, rounds + 1))
    total = listed("sum(x{i}) AS x{i}")
    rows = " UNION ALL ".join(f"SELECT * FROM e{k}" for k in range(1, rounds + 1))
    zero = listed("coalesce(x{i}, 0) AS x{i}")
    sides = ", ".join(
        f"{name}w AS (SELECT {key} AS id, string_split({clean('text')}, ' ') AS l FROM {source}), "
        f"{name}s AS (SELECT id, {listed('sum(x{i} - y{i}) / count(*) AS x{i}')} FROM (SELECT id, unnest(l) AS word FROM {name}w) "
        f"JOIN learnt USING (word) CROSS JOIN middle GROUP BY id), "
        f"{name} AS MATERIALIZED (SELECT id, [{listed('x{i} / nullif(norm, 0)')}] AS e FROM "
        f"(SELECT *, {norm} AS norm FROM (SELECT id, {zero} FROM {name}w LEFT JOIN {name}s USING (id))))"
        for name, source, key in (("dv", "documents", "doc_id"), ("qv", "benchmark", "item_id")))
    return (
        f"{tokens_cte('dt', 'documents', 'doc_id', None)}, {tokens_cte('qt', 'benchmark', 'item_id', None)}, "
        "placed AS MATERIALIZED (SELECT id, unnest(toks) AS word, unnest(range(len(toks))) AS p FROM (SELECT row_number() OVER () "
        "AS id, toks FROM (SELECT toks FROM dt UNION ALL SELECT toks FROM qt))), kept AS MATERIALIZED (SELECT word, tf FROM "
        "(SELECT word, count(DISTINCT id) AS df, count(*) AS tf FROM placed GROUP BY word) WHERE df >= 2 "
        "ORDER BY tf DESC, word LIMIT 20000), known AS (SELECT * FROM placed WHERE word IN (SELECT word FROM kept)), "
        "c AS MATERIALIZED (SELECT a.word AS a, b.word AS b, count(*) AS n FROM known a JOIN (SELECT id, word, p, unnest([-4, -3, -2, "
        "-1, 1, 2, 3, 4]) AS o FROM known) b ON a.id = b.id AND a.p = b.p + b.o GROUP BY ALL), "
        "r AS MATERIALIZED (SELECT a AS word, sum(n)::DOUBLE AS s FROM c GROUP BY a), m AS MATERIALIZED (SELECT * FROM (SELECT a, b, "
        "ln(n * (SELECT sum(s) FROM r) / (x.s * y.s)) AS v FROM c JOIN r x ON x.word = c.a JOIN r y ON y.word = c.b) WHERE v > 0), "
        f"e0 AS MATERIALIZED (SELECT word, {signs} FROM kept), {steps}, "
        f"learnt AS MATERIALIZED (SELECT kept.word, tf, {zero} FROM kept LEFT JOIN (SELECT word, {total} FROM ({rows}) GROUP BY word) t "
        f"USING (word)), middle AS MATERIALIZED (SELECT {listed('sum(tf * x{i}) / sum(tf) AS y{i}')} FROM learnt), {sides}")


def build() -> dict[str, str]:
    documents_clean = f"SELECT doc_id, {clean('text')} AS text_cleaned FROM documents"
    vocab_select = " SELECT term, df, tf, round(idf, 6) AS idf FROM vocab"
    base_vocab = f"WITH {FIT_DOCUMENTS}, {vocab_cte('dc', N_DOCUMENTS, 5000, 3)}{vocab_select}"
    sample = ("(SELECT title, job_id, text FROM (SELECT source AS title, doc_id AS job_id, text, row_number() OVER "
              "(PARTITION BY source ORDER BY md5(doc_id::VARCHAR || ':42')) AS n FROM documents WHERE source IS NOT NULL) "
              "WHERE n <= greatest(1, 200 // (SELECT count(DISTINCT source) FROM documents)))")
    stripped = (f"regexp_replace(regexp_replace(raw, '^{UNICODE_SPACE}', ''), '{UNICODE_SPACE}$', '')")
    lines = (f"SELECT conv_id, turn, line_no, line FROM (SELECT conv_id, turn, line_no, {stripped} AS line FROM "
             "(SELECT conv_id, turn, unnest(l) AS raw, unnest(generate_series(0, len(l) - 1)) AS line_no FROM "
             "(SELECT conv_id, turn, string_split(text, chr(10)) AS l FROM conversations))) WHERE line <> ''")
    semantic = (f"trim(regexp_replace(regexp_replace(nfc_normalize(coalesce(html, '')), '<[^\\n>]*>', ' ', 'g'), "
                f"'{UNICODE_SPACE}', ' ', 'g'))")
    raw_words = f"list_filter(regexp_split_to_array(coalesce(text, ''), '{UNICODE_SPACE}'), lambda w: w <> '')"
    lower_words = f"list_filter(regexp_split_to_array(lower(text), '{UNICODE_SPACE}'), lambda w: w <> '')"
    ranked_combined = f"WITH {both_sides('combined')}, {GRID}, {RANKED} "
    recruiter = f"{ranked_combined}SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10"
    requested = f"WITH {both_sides('combined')}, {REQUESTED} "
    def title_fit(lemmas: bool) -> str:
        return ", ".join([tokens_cte("dt", "documents", "doc_id", lemmas=lemmas), counts_cte("dc", "dt"),
                          tokens_cte("qt", "benchmark", "item_id", lemmas=lemmas), counts_cte("qc", "qt"),
                          vocab_cte("dc", N_DOCUMENTS, 5000, 3), weights_cte("dw", "dc", False),
                          weights_cte("qw", "qc", False)])

    best_titles = (
        f", {GRID}, best AS (SELECT g.*, d.source AS title, row_number() OVER (PARTITION BY item_id, "
        "d.source ORDER BY score DESC, doc_id) AS n FROM grid g JOIN documents d USING (doc_id)), "
        "ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank "
        "FROM best WHERE n = 1) SELECT item_id, rank, title, doc_id AS job_id, round(score, 4) AS score "
        "FROM ranked WHERE rank <= 10")
    applicant = f"WITH {title_fit(False)}{best_titles}"
    transformed = (f"WITH {FIT_DOCUMENTS}, {vocab_cte('dc', N_DOCUMENTS, 5000, 3)}, "
                   f"{weights_cte('dw', 'dc', False)} SELECT id AS doc_id, term, round(w, 6) AS w FROM dw")
    split = ("SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY md5(doc_id::VARCHAR || ':42')) <= "
             "ceil((SELECT count(*) FROM documents) * 0.1::DOUBLE) THEN 'validation' ELSE 'train' END AS split "
             "FROM documents")
    semantic_text = semantic.replace("html", "text")
    embedded = ", ".join(f"""
        {name} AS MATERIALIZED (SELECT id, list(v / nullif(norm, 0) ORDER BY dim) AS e, any_value(title) AS title FROM (
          SELECT *, sqrt(sum(v * v) OVER (PARTITION BY id)) AS norm FROM (
            SELECT id, dim, sum(CASE WHEN w = '' THEN 0 ELSE
                2 * ((('0x' || substr(md5(w), 1 + dim // 4, 1))::INT >> (3 - dim % 4)) & 1) - 1 END)::DOUBLE AS v,
                any_value(title) AS title
            FROM (SELECT {key} AS id, {title} AS title, unnest(CASE WHEN len(l) = 0 THEN [''] ELSE l END) AS w FROM
                  (SELECT *, list_filter(string_split(lower({semantic_text}), ' '), lambda w: w <> '') AS l FROM {source}))
            CROSS JOIN (SELECT unnest(range(64))::INT AS dim) GROUP BY id, dim)) GROUP BY id)"""
        for name, source, key, title in (("dv", "documents", "doc_id", "source"), ("qv", "benchmark", "item_id", "NULL")))
    # A text without words has no direction: all its components are 0.
    plain = "list_transform({0}.e, lambda x: coalesce(x, 0::DOUBLE))"
    text_pairs = ("pairs AS MATERIALIZED (SELECT qv.id AS item_id, dv.id AS doc_id, dv.title, round(list_inner_product("
                  f"{plain.format('qv')}, {plain.format('dv')}), 9) AS score FROM qv CROSS JOIN dv)")
    centered = ", ".join(f"""
        {name}c AS MATERIALIZED (SELECT id, list(coalesce(y / nullif(norm, 0), 0::DOUBLE) ORDER BY dim) AS e FROM (
          SELECT *, sqrt(sum(y * y) OVER (PARTITION BY id)) AS norm FROM (
            SELECT id, dim, x - mean AS y FROM
              (SELECT id, unnest({plain.format(name)}) AS x, unnest(range(64)) AS dim FROM {name}) JOIN means USING (dim)))
          GROUP BY id)""" for name in ("dv", "qv"))
    means = (f"means AS MATERIALIZED (SELECT dim, avg(x) AS mean FROM (SELECT unnest({plain.format('a')}) AS x, unnest(range(64)) "
             "AS dim FROM (SELECT e FROM dv UNION ALL SELECT e FROM qv) a) GROUP BY dim)")
    top_pairs = ("SELECT item_id, rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id "
                 "ORDER BY score DESC, doc_id) AS rank FROM pairs) WHERE rank <= 10")
    prepared = (
        f"WITH src AS MATERIALIZED (SELECT conv_id || '-' || turn || ':' || line_no AS doc_id, line AS text FROM ({lines})), "
        "held AS (SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY md5(doc_id || ':42')) <= "
        "ceil((SELECT count(*) FROM src) * 0.1::DOUBLE) THEN 'validation' ELSE 'train' END AS split FROM src), "
        f"masked AS ({_mask('src', 256)}) SELECT doc_id, split, pos, token, label, 1::BIGINT AS mask FROM masked "
        "JOIN held USING (doc_id) UNION ALL SELECT doc_id, split, pos, '[PAD]', NULL, 0 FROM "
        f"(SELECT doc_id, len({token_list(clean('text'))}) AS n FROM src) JOIN held USING (doc_id) "
        "CROSS JOIN range(256) r(pos) WHERE pos >= n")
    titles_dense = (
        f"WITH {DENSE}, best AS (SELECT * EXCLUDE (rank), row_number() OVER (PARTITION BY query_id, title "
        "ORDER BY score DESC, vec_id) AS n FROM pairs p), top AS (SELECT *, row_number() OVER "
        "(PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM best WHERE n = 1) "
        "SELECT query_id, rank, title, vec_id, score FROM top WHERE rank <= 5").replace("* EXCLUDE (rank)", "*")
    return {
        "mlm_prepared_lines": prepared,
        "embed_text": f"WITH {embedded} SELECT id AS doc_id, unnest(range(64)) AS dim, "
                      f"round(unnest({plain.format('dv')}), 6) AS value FROM dv",
        "recruiter_text_dense": f"WITH {embedded}, {text_pairs} {top_pairs}",
        "applicant_text_dense": (
            f"WITH {embedded}, {text_pairs}, best AS (SELECT *, row_number() OVER (PARTITION BY item_id, title "
            "ORDER BY score DESC, doc_id) AS n FROM pairs), top AS (SELECT *, row_number() OVER (PARTITION BY item_id "
            "ORDER BY score DESC, doc_id) AS rank FROM best WHERE n = 1) "
            "SELECT item_id, rank, title, doc_id AS job_id, score FROM top WHERE rank <= 10"),
        "domain_embedding_rank": (
            f"WITH {_domain_vectors()}, {means}, {centered}, pairs AS (SELECT qvc.id AS item_id, dvc.id AS doc_id, "
            f"round(list_inner_product(qvc.e, dvc.e), 9) AS score FROM qvc CROSS JOIN dvc) {top_pairs}"),
        "normalize_nfkc": "SELECT page_id, 'fi1⁄2A' || replace(coalesce(html, ''), chr(8195), ' ') || 'IV1kgガ' AS text_normalized "
                          "FROM pages",
        "recruiter_lemma_rank": f"WITH {_lexicon()}, {both_sides('combined', True)}, {GRID}, {RANKED} "
                                "SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10",
        "applicant_lemma_topk": f"WITH {_lexicon()}, {title_fit(True)}{best_titles}",
        "recruiter_response": f"SELECT item_id, string_agg(doc_id::VARCHAR, ' | ' ORDER BY rank) AS documents, "
                              f"{_message(MESSAGE_TOP, '10')} AS message FROM ({recruiter}) GROUP BY item_id",
        "clean_and_cache_jobs": (
            f"SELECT doc_id, source AS title, {clean('text')} AS text_cleaned FROM (SELECT * FROM documents "
            "WHERE source <> '' AND text <> '' ORDER BY md5(doc_id::VARCHAR || ':42') "
            "LIMIT (SELECT count(*) FROM benchmark))"),
        "load_resumes": "SELECT lang AS role, text FROM documents WHERE lang <> '' AND text <> ''",
        "load_jobs_sampled": "SELECT doc_id AS job_id, source AS title, text FROM documents "
                             "WHERE source <> '' AND text <> '' ORDER BY md5(doc_id::VARCHAR || ':42') LIMIT 100",
        "job_titles": "SELECT source AS title FROM documents",
        "read_through_clean": documents_clean,
        "vocab_roundtrip": base_vocab,
        "embedding_index": "SELECT vec_id, len(embedding) AS dim, label::VARCHAR AS title FROM embeddings",
        "versioned_save": "SELECT v AS version, (SELECT count(*) FROM documents) AS n_rows "
                          "FROM (VALUES ('20240201000000'), ('20240301000000')) t(v)",
        "version_retention": "WITH v AS (SELECT DISTINCT strftime(ts, '%Y%m%d') AS version FROM events) "
                             "SELECT version, row_number() OVER (ORDER BY version DESC) <= 2 AS keep FROM v",
        "version_label": "SELECT event_id, strftime(ts, '%d-%m-%Y_%H-%M-%S') AS label FROM events",
        "bulk_load_documents": "SELECT '.txt' AS type, coalesce(text, '') || chr(10) AS text FROM documents",
        "docx_documents": "SELECT doc_id::VARCHAR || '.docx' AS filename, replace(regexp_replace(coalesce(text, ''), "
                          "'[\\x01-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g'), chr(13), chr(10)) AS text FROM documents",
        "corpus_lines": lines,
        "corpus_lines_file": f"SELECT line FROM ({lines})",
        "dropna_any": "SELECT doc_id, text, quality::BIGINT AS quality FROM documents JOIN labels USING (doc_id) "
                      "WHERE text IS NOT NULL AND quality IS NOT NULL",
        "fill_null_text": "SELECT doc_id, CASE WHEN coalesce(toxic, 0) = 0 THEN coalesce(text, '') ELSE '' END AS text "
                          "FROM documents LEFT JOIN labels USING (doc_id)",
        "clean_text": documents_clean,
        "clean_text_keep_numbers": f"SELECT doc_id, {clean('text', numbers=False)} AS text_cleaned FROM documents",
        "clean_text_keep_stopwords": f"SELECT doc_id, {clean('text', stops=False)} AS text_cleaned FROM documents",
        "clean_column": documents_clean,
        "clean_text_semantic": f"SELECT page_id, {semantic} AS text_cleaned FROM pages",
        "tokenize": _positions(token_list(clean("text"))),
        "remove_stopwords": _positions(
            f"list_filter({lower_words}, lambda t: NOT list_contains({CLEANING_WORDS}, t))"),
        "ngrams": f"WITH {tokens_cte('dt', 'documents', 'doc_id', None)}, {counts_cte('dc', 'dt')} "
                  "SELECT id AS doc_id, term, tf FROM dc",
        "sanitize_label": r"SELECT page_id, regexp_replace(url, '[^\p{L}\p{N}_\-.]', '_', 'g') AS label FROM pages",
        "build_lemma_dict": f"WITH {_lexicon()} SELECT word, pos, lemma FROM lexicon",
        "lemmatize_lookup": (
            f"WITH {_lexicon()}, tok AS (SELECT doc_id, unnest(l) AS word, unnest(generate_series(0, len(l) - 1)) AS p "
            "FROM (SELECT doc_id, string_split(text_cleaned, ' ') AS l FROM cleaned)) "
            "SELECT doc_id, string_agg(coalesce(x.lemma, tok.word), ' ' ORDER BY p) AS text_lemmatized "
            "FROM tok LEFT JOIN (SELECT word, lemma FROM lexicon WHERE pos = 'noun') x USING (word) GROUP BY doc_id"),
        "term_stats": f"WITH {tokens_cte('dt', 'documents', 'doc_id', None)}, {counts_cte('dc', 'dt')} "
                      "SELECT term, count(*) AS df, sum(tf)::BIGINT AS tf FROM dc GROUP BY term",
        "term_counts": f"WITH {tokens_cte('dt', 'documents', 'doc_id', None)}, {counts_cte('dc', 'dt', 1)} "
                       "SELECT id AS doc_id, term, tf FROM dc",
        "tfidf_vocab": base_vocab,
        "vocab_upkeep": (
            f"WITH {tokens_cte('dt', '(SELECT * FROM documents WHERE coalesce(lang, $$$$) <> $$fr$$)', 'doc_id')}, "
            f"{counts_cte('dc', 'dt')}, {vocab_cte('dc', '(SELECT count(*) FROM dt)', 5000, 3)}{vocab_select}"),
        "tfidf_vocab_combined": f"WITH {both_sides('combined')}{vocab_select}",
        "tfidf_transform": transformed,
        "weights_roundtrip": transformed,
        "clean_and_cache": f"SELECT lang AS role, {clean('text')} AS text_cleaned FROM documents "
                           "WHERE lang <> '' AND text <> ''",
        "tfidf_transform_sublinear": f"WITH {FIT_DOCUMENTS}, {vocab_cte('dc', N_DOCUMENTS, 40000, 5)}, "
                                     f"{weights_cte('dw', 'dc', True)} SELECT id AS doc_id, term, round(w, 6) AS w FROM dw",
        "sparse_cosine": f"{requested}SELECT item_id, doc_id, score FROM grid WHERE score > 0",
        "sparse_cosine_full": f"{requested}SELECT item_id, doc_id, score FROM grid",
        "recruiter_request_rank": f"{requested}SELECT item_id, row_number() OVER (PARTITION BY item_id "
                                  "ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM grid",
        "recruiter_tfidf_rank": recruiter,
        "indexed_tfidf_rank": recruiter,
        "stream_score": recruiter,
        "stream_standing_topk": recruiter,
        "attach_title": f"SELECT item_id, doc_id AS job_id, source AS title, score FROM ({recruiter}) "
                        "JOIN documents USING (doc_id)",
        "match_debug": f"SELECT r.item_id, left({clean('b.text')}, 1000) AS preview, rank, doc_id, score "
                       f"FROM ({recruiter}) r JOIN benchmark b ON b.item_id = r.item_id",
        "text_previews": f"SELECT doc_id, left({clean('text')}, 300) AS preview FROM documents ORDER BY doc_id LIMIT 3",
        "applicant_tfidf_topk": applicant,
        "applicant_response": f"SELECT item_id, string_agg(title, ' | ' ORDER BY rank) AS titles, "
                              f"{_message(MESSAGE_TOP, '10')} AS message FROM ({applicant}) GROUP BY item_id",
        "batch_top5": (
            f"WITH {both_sides('base')}, {GRID}, ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id "
            "ORDER BY score DESC, item_id) AS rank FROM grid) SELECT doc_id AS resume_id, rank, item_id AS job_id, "
            "round(score, 4) AS score FROM ranked WHERE rank <= 5"),
        "topk_message": (
            "WITH n AS (SELECT count(DISTINCT source) + max((source IS NULL)::INT)::BIGINT AS available FROM documents) "
            "SELECT item_id, k, available, CASE "
            f"WHEN k IS NULL THEN {_message(MESSAGE_ALL, 'available')} "
            f"WHEN k > available THEN {_message(MESSAGE_FEWER, 'k', 'available', 'available')} "
            f"ELSE {_message(MESSAGE_TOP, 'k')} END AS message "
            "FROM benchmark CROSS JOIN (VALUES (NULL::BIGINT), (5), (1000000)) t(k) CROSS JOIN n"),
        "clip_scores": "SELECT vec_id, round(least(1.0::DOUBLE, list_inner_product(embedding::DOUBLE[], "
                       "embedding::DOUBLE[])), 6) AS match_score FROM embeddings",
        "similarity_stats": (
            f"WITH {both_sides('combined')}, {GRID} SELECT min(score) AS min, max(score) AS max, "
            "round(avg(score), 9) AS mean, median(score) AS median FROM grid"),
        "dense_inner_product": f"WITH {DENSE} SELECT query_id, vec_id, score FROM pairs",
        "recruiter_dense_rank": f"WITH {DENSE} SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10",
        "applicant_dense_topk": titles_dense,
        "applicant_dense_cells": titles_dense,
        "l2_normalize": (
            "SELECT vec_id, unnest(generate_series(0, len(embedding) - 1)) AS dim, "
            "unnest(list_transform(v, lambda x: round(x / sqrt(list_inner_product(v, v)), 6))) AS value FROM "
            "(SELECT vec_id, embedding, list_transform(embedding, lambda x: x::DOUBLE * 3) AS v FROM embeddings)"),
        "mean_pooling": (
            "SELECT label::BIGINT AS label, dim, round(sum(x * m) / greatest(sum(m), 1e-9::DOUBLE), 6) AS value FROM "
            "(SELECT label, (embedding[1] >= 0)::INT::DOUBLE AS m, unnest(embedding)::DOUBLE AS x, "
            "unnest(generate_series(0, len(embedding) - 1)) AS dim FROM embeddings) GROUP BY label, dim"),
        "distinct_titles": "SELECT count(DISTINCT source) AS n_distinct, count(DISTINCT source) + "
                           "max((source IS NULL)::INT)::BIGINT AS n_distinct_with_null FROM documents",
        "category_counts": "SELECT lang, count(*) AS cnt FROM documents WHERE lang IS NOT NULL GROUP BY lang "
                           "ORDER BY cnt DESC, lang LIMIT 5",
        "word_frequency": f"WITH {WORDS} SELECT word, cnt FROM counts ORDER BY cnt DESC, word LIMIT 30",
        "explore_report": _report(),
        "heavy_words": f"WITH {WORDS} SELECT word, cnt FROM counts ORDER BY cnt DESC, word LIMIT 30",
        "word_weights": f"WITH {WORDS} SELECT word, round(cnt / (SELECT max(cnt) FROM counts), 9) AS weight FROM counts",
        "doc_length": f"SELECT doc_id, len({raw_words}) AS n_words FROM documents",
        "length_histogram": (
            f"WITH l AS (SELECT len({raw_words}) AS n FROM documents), "
            "e AS (SELECT CASE WHEN min(n) = max(n) THEN min(n) - 0.5 ELSE min(n) END::DOUBLE AS lo, "
            "CASE WHEN min(n) = max(n) THEN max(n) + 0.5 ELSE max(n) END::DOUBLE AS hi FROM l), "
            "w AS (SELECT lo, (hi - lo) / 30 AS width FROM e), "
            "c AS (SELECT least(floor((n - lo) / width), 29)::BIGINT AS bin, count(*) AS cnt FROM l, w GROUP BY 1) "
            "SELECT bin, round(lo + bin * width, 6) AS lo, round(lo + (bin + 1) * width, 6) AS hi, "
            "coalesce(cnt, 0) AS cnt FROM range(30) r(bin) CROSS JOIN w LEFT JOIN c USING (bin)"),
        "top_words_by_category": (
            f"WITH {CLEANED}, top AS (SELECT lang FROM documents WHERE lang IS NOT NULL GROUP BY lang "
            "ORDER BY count(*) DESC, lang LIMIT 5), c AS (SELECT lang, word, count(*) AS cnt FROM "
            f"(SELECT lang, unnest({token_list('text_cleaned', VECTORIZER_WORDS)}) AS word FROM cleaned "
            "WHERE lang IN (SELECT lang FROM top)) GROUP BY ALL) SELECT lang, rank, word, cnt FROM "
            "(SELECT *, row_number() OVER (PARTITION BY lang ORDER BY cnt DESC, word) AS rank FROM c) WHERE rank <= 10"),
        "pairwise_similarity": (
            "WITH first AS (SELECT doc_id, text FROM documents ORDER BY doc_id LIMIT 100), "
            f"{tokens_cte('dt', 'first', 'doc_id', None)}, {counts_cte('dc', 'dt', 1)}, "
            f"{vocab_cte('dc', '(SELECT count(*) FROM first)', 100, 1, 1.0)}, {weights_cte('dw', 'dc', False)}, "
            "s AS (SELECT a.id AS doc_a, b.id AS doc_b, sum(a.w * b.w) AS s FROM dw a JOIN dw b USING (term) GROUP BY ALL) "
            "SELECT a.doc_id AS doc_a, b.doc_id AS doc_b, round(coalesce(s.s, 0), 9) AS score FROM first a CROSS JOIN "
            "first b LEFT JOIN s ON s.doc_a = a.doc_id AND s.doc_b = b.doc_id"),
        "similarity_join": (
            f"WITH {tokens_cte('dt', 'documents', 'doc_id', None)}, numbered AS (SELECT row_number() OVER () AS id, id AS doc_id, "
            f"toks, list_sort(toks) AS bag FROM dt), {counts_cte('dc', 'numbered', 1)}, "
            "vocab AS (SELECT term, ln((1.0::DOUBLE + (SELECT count(*) FROM dt)) / (1.0::DOUBLE + count(*))) + 1.0::DOUBLE "
            f"AS idf FROM dc GROUP BY term), {weights_cte('dw', 'dc', False)}, "
            "links AS (SELECT a.id AS a, b.id AS b FROM dw a JOIN dw b ON a.term = b.term AND a.id <> b.id GROUP BY ALL "
            "HAVING round(sum(a.w * b.w), 9) >= 0.8) SELECT doc_id, CASE WHEN len(toks) = 0 THEN doc_id ELSE "
            "min(doc_id) OVER (PARTITION BY bag) END AS class_id, coalesce(n, 0) AS n_links FROM numbered "
            "LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) ON a = id"),
        "word_information": (
            f"WITH {tokens_cte('dt', 'documents', 'doc_id', None)}, placed AS (SELECT id, unnest(toks) AS word, "
            "unnest(range(len(toks))) AS p FROM (SELECT row_number() OVER () AS id, toks FROM dt)), kept AS (SELECT word FROM "
            "(SELECT word, count(DISTINCT id) AS df, count(*) AS tf FROM placed GROUP BY word) WHERE df >= 2 "
            "ORDER BY tf DESC, word LIMIT 5000), known AS (SELECT * FROM placed WHERE word IN (SELECT word FROM kept)), "
            "c AS (SELECT a.word AS a, b.word AS b, count(*) AS n FROM known a JOIN (SELECT id, word, p, unnest([-4, -3, -2, -1, "
            "1, 2, 3, 4]) AS o FROM known) b ON a.id = b.id AND a.p = b.p + b.o GROUP BY ALL), "
            "r AS (SELECT a AS word, sum(n)::DOUBLE AS s FROM c GROUP BY a) "
            "SELECT c.a AS word, count(*) AS n_neighbours, sum(n)::BIGINT AS n_pairs, "
            "round(sum(greatest(ln(n * (SELECT sum(s) FROM r) / (x.s * y.s)), 0)), 6) AS information "
            "FROM c JOIN r x ON x.word = c.a JOIN r y ON y.word = c.b GROUP BY c.a"),
        "stratified_sample": f"SELECT title, job_id FROM {sample}",
        "stratified_summary": f"SELECT title, job_id FROM {sample}",
        "combined_corpus": f"SELECT 'resume' AS origin, item_id AS id, {clean('text')} AS text_cleaned FROM benchmark "
                           f"UNION ALL SELECT 'job', job_id, {clean('text')} FROM {sample}",
        "train_val_split": split,
        "pad_truncate": (
            f"WITH {tokens_cte('dt', 'documents', 'doc_id', None)} SELECT id AS doc_id, pos, "
            "coalesce(toks[pos + 1], '[PAD]') AS token, (pos < len(toks))::BIGINT AS mask "
            "FROM dt CROSS JOIN range(256) r(pos)"),
        "subword_pad": _subwords(),
        "mlm_mask": _mask(),
        "mlm_corpus": f"SELECT * FROM ({_mask()}) JOIN ({split}) USING (doc_id)",
    }
