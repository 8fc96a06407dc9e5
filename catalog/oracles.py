"""DuckDB twins of the registered queries, composed from named table expressions."""

from __future__ import annotations

from catalog import inputs as src
from corpuslens.functions.text import LEXICAL
from corpuslens.operators.many_models import HALF
from corpuslens.operators.reports import FULL, LEFT_OUT
from corpuslens.plans.features import (
    EMBEDDING_SCORES,
    LEXICAL_GROUP,
    LEXICON_GROUP,
    RATIO_COLUMNS,
    SENTIMENT_GROUP,
)


def values(rows) -> str:
    def cell(x) -> str:
        return f"'{x}'" if isinstance(x, str) else repr(x)

    return "(VALUES " + ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows) + ")"


def words_of(name: str) -> str:
    return ", ".join(f"'{w}'" for w, c in src.CLASSES if c == name)


def clean(text: str) -> str:
    url = r"(https?://|www\.)[^\s\x0b\x1c-\x1f\x{85}\p{Z}]+"
    no_url = f"regexp_replace(lower({text}), '{url}', ' ', 'g')"
    return f"trim(regexp_replace({no_url}, '[^a-z0-9]+', ' ', 'g'))"


def ratio(part: str, whole: str) -> str:
    return f"coalesce(({part})::DOUBLE / nullif({whole}, 0), 0.0)"


def char_count(char: str) -> str:
    return f"(len(text) - len(replace(text, '{char}', '')))"


def r6(expr: str) -> str:
    return f"round(({expr})::DOUBLE, 6)"


def syllables(word: str) -> str:
    letters = f"regexp_replace({word}, '[^a-z]', '', 'g')"
    groups = f"len(regexp_extract_all({letters}, '[aeiouy]+'))"
    return (
        f"CASE WHEN {letters} = '' THEN 0 ELSE greatest({groups} - CASE WHEN "
        f"{letters} LIKE '%e' AND {groups} > 1 THEN 1 ELSE 0 END, 1) END"
    )


LEXICON_SET = ", ".join(f"'{t}'" for t in src.LEXICON)
PUNCTUATION = f"({char_count('!')} + {char_count('?')} + {char_count('.')})"

CTES: dict[str, str] = {
    "docs": "SELECT 'p' || (CAST(substr(source, 4) AS INT) % 3) AS dataset, doc_id AS id, "
    "coalesce(text, '') AS text FROM documents",
    "turns": "SELECT 'p' || (conv_id % 3) AS dataset, conv_id * 1000 + turn AS id, "
    "coalesce(text, '') AS text FROM conversations",
    "lab": "SELECT doc_id AS id, toxic AS label FROM labels",
    "posts": "SELECT dataset, id, text, label FROM docs JOIN lab USING (id)",
    "cleaned": f"SELECT dataset, id, text, {clean('text')} AS clean FROM docs",
    "tok": "SELECT dataset, id, text, clean, CASE WHEN clean = '' THEN []::VARCHAR[] "
    "ELSE string_split(clean, ' ') END AS tokens FROM cleaned",
    "word_counts": "SELECT id, word, count(*) AS n FROM "
    "(SELECT id, unnest(tokens) AS word FROM tok) GROUP BY ALL",
    "chars": "SELECT id, unnest(string_split(text, '')) AS ch, "
    "generate_subscripts(string_split(text, ''), 1) AS pos FROM docs",
    "runs": "SELECT id, count(*) AS repeated FROM (SELECT id, ch, g FROM (SELECT id, ch, "
    "pos - row_number() OVER (PARTITION BY id, ch ORDER BY pos) AS g FROM chars) "
    "WHERE ch <> chr(10) GROUP BY id, ch, g HAVING count(*) >= 3) GROUP BY id",
    "lexical": "SELECT dataset, id, len(tokens) AS num_words, "
    + ratio("list_sum(list_transform(tokens, lambda t: len(t)))", "len(tokens)")
    + " AS avg_word_len, "
    + ratio(r"len(regexp_extract_all(text, '\p{Lu}'))", r"len(regexp_extract_all(text, '\p{L}'))")
    + " AS uppercase_ratio, "
    + ratio(char_count("!"), "len(text)") + " AS exclamation_ratio, "
    + ratio(char_count("?"), "len(text)") + " AS question_ratio, "
    + ratio(char_count("."), "len(text)") + " AS period_ratio, "
    + PUNCTUATION + " AS punctuation_count, "
    "len(regexp_extract_all(text, '[!?.]{2,}')) AS multiple_count, len(text) AS char_count, "
    "coalesce(repeated, 0) AS repeated_chars, len(list_distinct(tokens)) AS unique_words, "
    "len(tokens) - len(list_distinct(tokens)) AS word_repetition, "
    "coalesce(list_max(list_transform(tokens, lambda t: len(t))), 0) AS longest_word_length, "
    "coalesce(list_min(list_transform(tokens, lambda t: len(t))), 0) AS shortest_word_length "
    "FROM tok LEFT JOIN runs USING (id)",
    "spoken": f"SELECT id, sum(n * ({syllables('word')})) AS spoken FROM word_counts GROUP BY id",
    "grade": "SELECT id, 0.39::DOUBLE * (greatest(1, len(tokens))::DOUBLE / "
    f"greatest(1, {PUNCTUATION})) + 11.8::DOUBLE * (greatest(1, coalesce(spoken, 0))::DOUBLE / "
    "greatest(1, len(tokens))) - 15.59::DOUBLE AS language_complexity_index "
    "FROM tok LEFT JOIN spoken USING (id)",
    "hit": f"SELECT dataset, id, tokens, len(list_filter(tokens, lambda t: t IN ({LEXICON_SET}))) "
    "AS hits FROM tok",
    "lexicon": "SELECT dataset, id, hits AS hate_word_count, "
    + ratio("hits", "len(tokens)")
    + " AS hate_word_ratio, (hits > 0)::INT AS contains_hate_word FROM hit",
    "mood": "SELECT id, sum(n * polarity::DECIMAL(18,6))::DOUBLE / sum(n) AS p, "
    "sum(n * subjectivity::DECIMAL(18,6))::DOUBLE / sum(n) AS s FROM word_counts JOIN "
    f"{values(src.POLARITY)} AS v(word, polarity, subjectivity) USING (word) GROUP BY id",
    "feeling": "SELECT dataset, id, coalesce(p, 0.0) AS p, coalesce(s, 0.0) AS s "
    "FROM docs LEFT JOIN mood USING (id)",
    "sentiment": "SELECT dataset, id, p AS sentiment_polarity, s AS sentiment_subjectivity, "
    "abs(p) AS sentiment_magnitude, (p < -0.1::DOUBLE)::INT AS sentiment_negative, "
    "(p BETWEEN -0.1::DOUBLE AND 0.1::DOUBLE)::INT AS sentiment_neutral, "
    "(p > 0.1::DOUBLE)::INT AS sentiment_positive, "
    "(p < -0.5::DOUBLE)::INT AS sentiment_very_negative, "
    "(p > 0.5::DOUBLE)::INT AS sentiment_very_positive, "
    "(s > 0.7::DOUBLE)::INT AS highly_subjective, (s < 0.3::DOUBLE)::INT AS highly_objective "
    "FROM feeling",
    "classes": "SELECT dataset, id, "
    + ", ".join(
        ratio(f"len(list_filter(tokens, lambda t: t IN ({words_of(c)})))", "len(tokens)")
        + f" AS {n}"
        for c, n in (("NOUN", "noun_ratio"), ("VERB", "verb_ratio"), ("ADJ", "adj_ratio"))
    )
    + " FROM tok",
    "pronouns": "SELECT dataset, id, "
    + ", ".join(
        ratio(f"len(list_filter(tokens, lambda t: t = '{w}'))", "len(tokens)") + f" AS {w}_ratio"
        for w in src.COUNTED_WORDS
    )
    + " FROM tok",
    "kept": "SELECT dataset, id, list_filter(tokens, lambda t: len(t) >= 2) AS w FROM tok",
    "tf": "SELECT dataset, id, term, count(*) AS tf FROM (SELECT dataset, id, unnest("
    "list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) "
    "AS term FROM kept) GROUP BY ALL",
    "stats": "SELECT dataset, term, sum(tf)::BIGINT AS total, count(*) AS df FROM tf GROUP BY ALL",
    "vocab": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dataset "
    "ORDER BY total DESC, term) AS rank FROM stats) WHERE rank <= 10000",
    "sizes": "SELECT dataset, count(*) AS n_rows FROM docs GROUP BY dataset",
    "idf": "SELECT dataset, term, df, n_rows, ln((1 + n_rows)::DOUBLE / (1 + df)) + 1 AS idf "
    "FROM vocab JOIN sizes USING (dataset)",
    "raw": "SELECT dataset, id, term, (1 + ln(tf::DOUBLE)) * idf AS w FROM tf "
    "JOIN idf USING (dataset, term)",
    "weights": "SELECT dataset, id, term, w / sqrt(sum(w * w) OVER (PARTITION BY dataset, id)) "
    "AS weight FROM raw",
    "said_kept": "SELECT dataset, id, list_filter(string_split(clean, ' '), "
    f"lambda t: len(t) >= 2) AS w FROM (SELECT dataset, id, {clean('text')} AS clean FROM turns)",
    "said_tf": "SELECT dataset, id, term, count(*) AS tf FROM (SELECT dataset, id, unnest("
    "list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) "
    "AS term FROM said_kept) GROUP BY ALL",
    "said_raw": "SELECT dataset, id, term, (1 + ln(tf::DOUBLE)) * idf AS w FROM said_tf "
    "JOIN idf USING (dataset, term)",
    "post_stats": "SELECT dataset, term, sum(tf) AS total, count(*) AS df FROM tf "
    "JOIN lab USING (id) GROUP BY ALL",
    "post_vocab": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dataset "
    "ORDER BY total DESC, term) AS rank FROM post_stats) WHERE rank <= 10000",
    "post_sizes": "SELECT dataset, count(*) AS n_rows FROM posts GROUP BY dataset",
    "post_raw": "SELECT dataset, id, (1 + ln(tf::DOUBLE)) * (ln((1 + n_rows)::DOUBLE / (1 + df)) "
    "+ 1) AS w FROM tf JOIN post_vocab USING (dataset, term) JOIN post_sizes USING (dataset)",
    "post_cells": "SELECT id, count(*) AS cells, sum(w) / sqrt(sum(w * w)) AS total "
    "FROM post_raw GROUP BY id",
    "emb": "SELECT vec_id AS id, embedding::DOUBLE[] AS embedding FROM embeddings",
    "cells": "SELECT id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS pos FROM emb",
    "lexicon_center": "SELECT list(v ORDER BY pos) AS center FROM (SELECT pos, avg(v) AS v "
    "FROM cells WHERE id IN (SELECT id FROM hit WHERE hits > 0) GROUP BY pos)",
    "alike": "SELECT id, list_cosine_similarity(embedding, center) AS similarity "
    "FROM emb, lexicon_center",
    "neutral": "SELECT dataset, list(v ORDER BY pos) AS center FROM (SELECT dataset, pos, "
    "avg(v) AS v FROM cells JOIN docs USING (id) JOIN lab USING (id) WHERE label = 0 "
    "GROUP BY ALL) GROUP BY dataset",
    "distance": "SELECT dataset, id, 1 - list_cosine_similarity(embedding, center) AS distance "
    "FROM emb JOIN docs USING (id) LEFT JOIN neutral USING (dataset)",
    "scored": "SELECT dataset, id, label, contains_hate_word AS prediction, "
    "hate_word_ratio AS score, hate_word_count AS hits, len(tokens) AS words "
    "FROM posts JOIN lexicon USING (dataset, id) JOIN (SELECT id, tokens FROM tok) USING (id)",
    "folded": "SELECT *, (row_number() OVER (PARTITION BY dataset, label "
    f"ORDER BY md5('{src.SEED}|' || id)) - 1) % 5 + 1 AS fold FROM scored",
}

COUNTS = (
    "count(*) FILTER (label = 1 AND prediction = 1) AS true_positives, "
    "count(*) FILTER (label = 0 AND prediction = 0) AS true_negatives, "
    "count(*) FILTER (label = 0 AND prediction = 1) AS false_positives, "
    "count(*) FILTER (label = 1 AND prediction = 0) AS false_negatives"
)
ACCURACY = ratio(
    "true_positives + true_negatives",
    "true_positives + true_negatives + false_positives + false_negatives",
)
PRECISION = ratio("true_positives", "true_positives + false_positives")
RECALL = ratio("true_positives", "true_positives + false_negatives")
F1 = ratio("2 * true_positives", "2 * true_positives + false_positives + false_negatives")
METRICS = f"{ACCURACY} AS accuracy, {PRECISION} AS precision, {RECALL} AS recall, {F1} AS f1"


def auc(table: str, keys: str) -> str:
    """AUC per key of a scored table: positive over negative pairs, ties half."""
    return (
        f"SELECT {keys}, CASE WHEN sum(pos) * sum(neg) > 0 THEN sum(pos * (below + neg / 2.0))"
        f"::DOUBLE / (sum(pos) * sum(neg)) ELSE 0.0 END AS roc_auc FROM (SELECT *, "
        f"sum(neg) OVER (PARTITION BY {keys} ORDER BY score) - neg AS below FROM (SELECT {keys}, "
        f"score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg "
        f"FROM {table} GROUP BY ALL)) GROUP BY {keys}"
    )


CTES |= {
    "fold_counts": f"SELECT dataset, fold, {COUNTS} FROM folded GROUP BY dataset, fold",
    "fold_auc": auc("folded", "dataset, fold"),
    "fold_rows": f"SELECT *, {METRICS} FROM fold_counts JOIN fold_auc USING (dataset, fold)",
    "summary": "SELECT dataset, count(*) AS n_folds, "
    + ", ".join(
        f"avg({m}) AS {m}_mean, stddev_pop({m}) AS {m}_std"
        for m in ("f1", "accuracy", "precision", "recall", "roc_auc")
    )
    + " FROM fold_rows GROUP BY dataset",
    "pooled": f"SELECT dataset, {COUNTS} FROM scored GROUP BY dataset",
    "tried": "SELECT dataset, experiment, label, (hits >= h AND words <= w)::INT AS prediction "
    f"FROM scored, {values(src.EXPERIMENTS)} AS e(experiment, h, w)",
    "results": f"SELECT dataset, experiment, {ACCURACY} AS accuracy, {F1} AS f1 FROM "
    f"(SELECT dataset, experiment, {COUNTS} FROM tried GROUP BY ALL)",
    "deltas": "SELECT r.dataset, g.feature_group, round(b.f1 - r.f1, 6) AS delta_f1 "
    f"FROM results r JOIN {values((g, e) for g, e in LEFT_OUT.items())} "
    "AS g(feature_group, experiment) USING (experiment) "
    f"JOIN results b ON b.dataset = r.dataset AND b.experiment = '{FULL}'",
    "limits": "SELECT dataset AS train_dataset, round(avg(score) / 2, 6) AS lowest FROM scored "
    "WHERE label = 1 GROUP BY dataset",
    "transfer": f"SELECT train_dataset, test_dataset, {F1} AS f1 FROM (SELECT train_dataset, "
    f"test_dataset, {COUNTS} FROM (SELECT train_dataset, dataset AS test_dataset, label, "
    "(score >= lowest)::INT AS prediction FROM scored, limits) GROUP BY ALL)",
    "drops": "SELECT t.train_dataset, t.test_dataset, t.f1, 100 * (o.f1 - t.f1) / nullif(o.f1, 0) "
    "AS f1_drop_pct FROM transfer t JOIN transfer o ON o.train_dataset = t.train_dataset "
    "AND o.test_dataset = t.train_dataset",
    "part": "SELECT * FROM results WHERE dataset <> 'p2' OR f1 > 0.5",
}


def needed(sql: str) -> list[str]:
    """Names of the table expressions that ``sql`` mentions, dependencies first."""
    import re

    found: list[str] = []
    # A recursive expression mentions itself.
    begun: set[str] = set()

    def visit(text: str) -> None:
        for name in re.findall(r"(?:FROM|JOIN|,)\s+([a-z_0-9]+)", text):
            if name in CTES and name not in begun:
                begun.add(name)
                visit(CTES[name])
                found.append(name)

    visit(sql)
    return found


def composed(sql: str) -> str:
    # What a recursion reads in every step is made once.
    parts = [f"{name} AS {'MATERIALIZED ' * (name == 'row_train')}({CTES[name]})" for name in needed(sql)]
    return (f"WITH RECURSIVE {', '.join(parts)} " if parts else "") + sql


def listed(names, rounded=()) -> str:
    return ", ".join(f"{r6(n)} AS {n}" if n in rounded else n for n in names)


REAL = (
    [n for n in LEXICAL if n.endswith("ratio") or n.startswith("avg")]
    + ["language_complexity_index", "hate_word_ratio"]
    + list(SENTIMENT_GROUP[:3])
    + list(RATIO_COLUMNS)
    + list(EMBEDDING_SCORES)
)
FIVE = ("f1", "accuracy", "precision", "recall", "roc_auc")
ROW_FEATURES = (
    "lexical JOIN grade USING (id) JOIN lexicon USING (dataset, id) "
    "JOIN sentiment USING (dataset, id) JOIN classes USING (dataset, id) "
    "JOIN pronouns USING (dataset, id)"
)
DENSE = (*LEXICAL_GROUP, *LEXICON_GROUP, *SENTIMENT_GROUP, *RATIO_COLUMNS)


def report_line(name: str, hit: str, wrong: str, missed: str) -> str:
    return (
        f"SELECT dataset, '{name}' AS class, {ratio(hit, f'{hit} + {wrong}')} AS precision, "
        f"{ratio(hit, f'{hit} + {missed}')} AS recall, "
        f"{ratio(f'2 * {hit}', f'2 * {hit} + {wrong} + {missed}')} AS f1, {hit} + {missed} "
        "AS support, true_positives + true_negatives AS correct FROM pooled"
    )


CTES["by_class"] = (
    report_line("0", "true_negatives", "false_negatives", "false_positives")
    + " UNION ALL "
    + report_line("1", "true_positives", "false_positives", "false_negatives")
)


def weighted(name: str) -> str:
    return f"sum({name} * support)::DOUBLE / sum(support)"


def mean_std(name: str) -> str:
    return f"printf('%.4f ± %.4f', {name}_mean, {name}_std) AS {name}"


BODIES: dict[str, str] = {
    "load_posts": "SELECT 'documents' AS dataset, doc_id AS id, toxic AS label, "
    "md5(coalesce(text, '')) AS text_md5 FROM documents JOIN labels USING (doc_id)",
    "platform_union": "SELECT dataset, id, len(text) AS n_chars FROM docs",
    "dataset_profile": "SELECT dataset, count(*) AS n_rows, sum(label)::BIGINT AS n_positive, "
    "count(*) - count(label) AS n_unlabelled, round(avg(label), 6) AS positive_ratio "
    "FROM posts GROUP BY dataset",
    "lexicon_build": "SELECT DISTINCT lower(term) AS term FROM (SELECT term FROM base UNION ALL "
    "SELECT term || 's' FROM base WHERE term NOT LIKE '%s' UNION ALL "
    "SELECT translate(term, 'aeo', '430') FROM base UNION ALL SELECT term || 'z' FROM base) "
    r"WHERE len(term) > 2 AND (regexp_full_match(term, '\p{L}+') OR contains(term, ' '))",
    "clean_text": "SELECT id, clean FROM cleaned",
    "tokens": "SELECT id, len(tokens) AS n_tokens, array_to_string(tokens, '|') AS tokens FROM tok",
    "lexical_features": f"SELECT id, {listed(LEXICAL, REAL)} FROM lexical",
    "syllables": f"SELECT word, {syllables('word')} AS syllables FROM "
    "(SELECT DISTINCT word FROM word_counts)",
    "readability": f"SELECT id, {listed(['language_complexity_index'], REAL)} FROM grade",
    "lexicon_features": f"SELECT dataset, id, {listed(LEXICON_GROUP, REAL)} FROM lexicon",
    "sentiment": f"SELECT id, {listed(SENTIMENT_GROUP, REAL)} FROM sentiment",
    "token_class_ratios": f"SELECT id, {listed(RATIO_COLUMNS[:3], REAL)} FROM classes",
    "lexicon_features_large": f"SELECT dataset, id, {listed(LEXICON_GROUP, REAL)} FROM big_lexicon",
    "sentiment_large": f"SELECT id, {listed(SENTIMENT_GROUP, REAL)} FROM big_sentiment",
    "token_classes_large": f"SELECT id, {listed(RATIO_COLUMNS[:3], REAL)} FROM big_classes",
    "word2vec_embeddings": "SELECT dataset, id, 16 AS width, (n_frequent IS NULL)::INT AS is_zero "
    "FROM docs LEFT JOIN (SELECT id, count(*) AS n_frequent FROM word_counts JOIN (SELECT word "
    "FROM word_counts GROUP BY word HAVING sum(n) >= 5) USING (word) GROUP BY id) USING (id)",
    "regime_rows": "SELECT regime, train_dataset, test_dataset, fold, count(*) AS n_rows, "
    "sum(label)::BIGINT AS n_positive FROM ("
    "SELECT 'cv' AS regime, dataset AS train_dataset, dataset AS test_dataset, fold, label FROM folded "
    "UNION ALL SELECT 'cross', t.dataset, f.dataset, fold, label FROM folded f JOIN "
    "(SELECT DISTINCT dataset FROM folded) t ON t.dataset <> f.dataset "
    "UNION ALL SELECT 'loo', 'all_except_' || dataset, dataset, fold, label FROM folded "
    "UNION ALL SELECT 'global', 'all', dataset, fold, label FROM folded) GROUP BY ALL",
    "pronoun_ratios": "SELECT id, "
    + ", ".join(f"{r6(f'{w}_ratio')} AS {w}_ratio" for w in src.COUNTED_WORDS)
    + " FROM pronouns",
    "source_one_hot": "SELECT id, "
    + ", ".join(f"(dataset = '{d}')::INT AS source_{d}" for d in src.DATASETS)
    + " FROM docs",
    "label_feature_averages": "SELECT dataset, label, count(*) AS n_rows, "
    + ", ".join(f"{r6(f'avg({n})')} AS {n}" for n in DENSE)
    + f" FROM lab JOIN (SELECT * FROM {ROW_FEATURES}) USING (id) GROUP BY dataset, label",
    "ngrams": "SELECT dataset, term, total, df FROM stats",
    "tfidf_vocab": "SELECT dataset, term, total, rank FROM vocab",
    "tfidf_idf": "SELECT dataset, term, df, n_rows, round(idf, 6) AS idf FROM idf",
    "tfidf_columns": "SELECT dataset, 'tfidf_' || term AS column_name, row_number() OVER "
    "(PARTITION BY dataset ORDER BY term) - 1 AS index FROM vocab",
    "tfidf_weights": "SELECT dataset, id, term, round(weight, 6) AS weight FROM weights",
    "tfidf_transform": "SELECT dataset, id, term, round(w / sqrt(sum(w * w) OVER "
    "(PARTITION BY dataset, id)), 6) AS weight FROM said_raw",
    "column_alignment": "SELECT id, term, round(weight, 6) AS weight FROM weights "
    "WHERE dataset = 'p1' AND term IN (SELECT term FROM vocab WHERE dataset = 'p0')",
    "precomputed_embeddings": f"SELECT dataset, id, {src.EMBEDDING_SIZE} AS width, "
    "round(coalesce(embedding[1], 0.0), 6) AS embed_0 FROM docs LEFT JOIN emb USING (id)",
    "encoded_embeddings": "SELECT id, "
    + ", ".join(
        f"round(((len(clean) - len(replace(clean, '{c}', '')))::DOUBLE / greatest(len(clean), 1))"
        f"::FLOAT::DOUBLE, 4) AS embed_{i}"
        for i, c in enumerate("aes")
    )
    + " FROM cleaned",
    "centroid": "SELECT label, pos - 1 AS position, round(avg(v), 6) AS value FROM cells "
    "JOIN (SELECT vec_id AS id, label FROM embeddings) USING (id) GROUP BY label, pos",
    "cosine_to_centroid": "SELECT id, round(similarity, 6) AS hate_lexicon_similarity FROM alike",
    "distance_to_neutral": "SELECT dataset, id, round(distance, 6) AS "
    "embedding_distance_to_neutral FROM distance",
    "embedding_columns": "SELECT id, "
    + ", ".join(f"round(embedding[{i + 1}], 6) AS embed_{i}" for i in range(src.EMBEDDING_SIZE))
    + " FROM emb",
    "feature_matrix": f"SELECT dataset, id, {listed(DENSE, REAL)}, "
    "round(coalesce(similarity, 0.0), 6) AS hate_lexicon_similarity, "
    "round(CASE WHEN center IS NULL THEN 0.0 ELSE coalesce(distance, 1.0) END, 6) "
    f"AS embedding_distance_to_neutral FROM {ROW_FEATURES} LEFT JOIN alike USING (id) "
    "LEFT JOIN (SELECT id, distance FROM distance) USING (id) LEFT JOIN neutral USING (dataset)",
    "extracted_features": "SELECT dataset, id, num_words, hate_word_count, "
    "round(coalesce(similarity, 0.0), 6) AS hate_lexicon_similarity, "
    "round(CASE WHEN center IS NULL THEN 0.0 ELSE coalesce(distance, 1.0) END, 6) "
    "AS embedding_distance_to_neutral, coalesce(cells, 0) AS tfidf_cells, "
    "round(coalesce(total, 0.0), 6) AS tfidf_total FROM lexical JOIN lexicon USING (dataset, id) "
    "LEFT JOIN alike USING (id) LEFT JOIN (SELECT id, distance FROM distance) USING (id) "
    "LEFT JOIN neutral USING (dataset) LEFT JOIN post_cells USING (id)",
    "fill_missing": "SELECT dataset, id, coalesce(quality, 0) AS quality, coalesce(toxic, 0) "
    "AS toxic FROM docs LEFT JOIN labels ON id = doc_id",
    "union_align": "SELECT dataset, id, len(text) AS doc_chars, 0 AS turn_chars FROM docs "
    "UNION ALL SELECT dataset, id, 0, len(text) FROM turns",
    "stratified_folds": "SELECT dataset, id, label, fold FROM folded",
    "stratified_holdout": "SELECT dataset, id, label, (row_number() OVER (PARTITION BY dataset, "
    f"label ORDER BY md5('{src.SEED}|' || id)) <= round(0.2 * count(*) OVER (PARTITION BY dataset, "
    "label)))::INT AS is_test FROM posts",
    "class_guard": "SELECT source, id, label FROM (SELECT source, doc_id AS id FROM documents) "
    "JOIN lab USING (id) WHERE source IN (SELECT source FROM documents JOIN labels USING (doc_id) "
    "GROUP BY source HAVING count(DISTINCT toxic) > 1)",
    "class_weights": "SELECT dataset, id, label, round(count(*) OVER (PARTITION BY dataset)::DOUBLE "
    "/ (2 * count(*) OVER (PARTITION BY dataset, label)), 6) AS weight FROM posts",
    "confusion": "SELECT dataset, fold, true_positives, true_negatives, false_positives, "
    "false_negatives FROM fold_counts",
    "confusion_pooled": "SELECT * FROM pooled",
    "metrics": "SELECT dataset, fold, true_positives, true_negatives, false_positives, "
    f"false_negatives, {listed(FIVE, FIVE)} FROM fold_rows",
    "roc_auc": f"SELECT dataset, round(roc_auc, 6) AS roc_auc FROM ({auc('scored', 'dataset')})",
    "classification_report": "SELECT dataset, class, round(precision, 6) AS precision, "
    "round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM by_class UNION ALL "
    "SELECT dataset, 'macro avg', round(avg(precision), 6), round(avg(recall), 6), "
    "round(avg(f1), 6), sum(support)::BIGINT FROM by_class GROUP BY dataset UNION ALL "
    f"SELECT dataset, 'weighted avg', round({weighted('precision')}, 6), "
    f"round({weighted('recall')}, 6), round({weighted('f1')}, 6), sum(support)::BIGINT "
    "FROM by_class GROUP BY dataset UNION ALL "
    "SELECT dataset, 'accuracy', round(max(correct) / sum(support), 6), "
    "round(max(correct) / sum(support), 6), round(max(correct) / sum(support), 6), "
    "sum(support)::BIGINT FROM by_class GROUP BY dataset",
    "fold_summary": "SELECT dataset, n_folds, "
    + ", ".join(f"round({m}_mean, 6) AS {m}_mean, round({m}_std, 6) AS {m}_std" for m in FIVE)
    + " FROM summary",
    "cv_summary": "SELECT upper(dataset[1]) || dataset[2:] AS dataset, "
    + ", ".join(mean_std(m) for m in ("f1", "accuracy", "precision", "recall"))
    + " FROM summary",
    "combined_results": "SELECT dataset, experiment, round(accuracy, 6) AS accuracy, "
    "round(f1, 6) AS f1 FROM results",
    "delta_f1": "SELECT dataset, feature_group, delta_f1 FROM deltas",
    "f1_pivot": "SELECT experiment, "
    + ", ".join(f"round(max(f1) FILTER (dataset = '{d}'), 6) AS {d}" for d in src.DATASETS)
    + " FROM results GROUP BY experiment",
    "group_ranking": "SELECT dataset, feature_group, delta_f1, row_number() OVER "
    "(PARTITION BY dataset ORDER BY delta_f1 DESC, feature_group) AS rank FROM deltas",
    "dense_grid": "SELECT dataset, experiment, replace(experiment, '_', ' ') AS experiment_clean, "
    "round(coalesce(f1, 0.0), 6) AS f1 FROM (SELECT DISTINCT dataset FROM part) CROSS JOIN "
    "(SELECT DISTINCT experiment FROM part) LEFT JOIN part USING (dataset, experiment)",
    "f1_drop": "SELECT train_dataset, test_dataset, round(f1, 6) AS f1, "
    "round(f1_drop_pct, 6) AS f1_drop_pct FROM drops",
    "cross_pivot": "SELECT train_dataset, "
    + ", ".join(
        f"round(max({m}) FILTER (test_dataset = '{d}'), 6) AS {d}_{m}"
        for d in src.DATASETS
        for m in ("f1", "f1_drop_pct")
    )
    + " FROM drops GROUP BY train_dataset",
    "nested_transfer": "SELECT train_dataset, test_dataset, round(f1, 6) AS f1 FROM drops",
}

CTES["big"] = (
    "SELECT word, (len(word) % 7) / 4.0::DOUBLE - 0.75::DOUBLE AS polarity, "
    "(len(word) % 5) / 4.0::DOUBLE AS subjectivity, "
    "CASE (len(word) // 2) % 4 WHEN 0 THEN 'NOUN' WHEN 1 THEN 'VERB' WHEN 2 THEN 'ADJ' END AS class "
    "FROM (SELECT DISTINCT word FROM word_counts) WHERE len(word) % 2 = 0"
)
CTES["big_hits"] = (
    "SELECT id, sum(n) AS hits, sum(n * polarity) / sum(n) AS p, sum(n * subjectivity) / sum(n) AS s, "
    + ", ".join(f"sum(n) FILTER (class = '{c}') AS {c.lower()}" for c in ("NOUN", "VERB", "ADJ"))
    + " FROM word_counts JOIN big USING (word) GROUP BY id"
)
CTES["big_rows"] = (
    "SELECT dataset, id, tokens, coalesce(hits, 0)::INT AS hits, coalesce(p, 0.0) AS p, "
    "coalesce(s, 0.0) AS s, coalesce(noun, 0) AS noun, coalesce(verb, 0) AS verb, "
    "coalesce(adj, 0) AS adj FROM tok LEFT JOIN big_hits USING (id)"
)
CTES["big_lexicon"] = CTES["lexicon"].replace("FROM hit", "FROM big_rows")
CTES["big_sentiment"] = CTES["sentiment"].replace("FROM feeling", "FROM big_rows")
CTES["big_classes"] = "SELECT dataset, id, " + ", ".join(
    f"{ratio(c, 'len(tokens)')} AS {c}_ratio" for c in ("noun", "verb", "adj")
) + " FROM big_rows"
CTES["base"] = "SELECT DISTINCT term FROM (SELECT unnest(string_split(text, ' ')) AS term FROM docs) WHERE term <> ''"

# Experiments of one group of row features: name, columns.
ROW_EXPERIMENTS = (
    ("C_LEXICAL_ONLY", LEXICAL_GROUP), ("D_HATE_LEXICON_ONLY", LEXICON_GROUP), ("E_SENTIMENT_ONLY", SENTIMENT_GROUP),
)
NEWTON_STEPS = 30
_width = 1 + max(len(columns) for _, columns in ROW_EXPERIMENTS)


def _eliminated(matrix: str, pivot: int) -> str:
    """One step of Gauss and Jordan; the curvature is positive definite, so pivots stay on the diagonal."""
    row = (
        f"CASE WHEN i = {pivot} THEN list_transform(r, lambda v: v / r[{pivot}]) "
        f"ELSE list_transform(r, lambda v, j: v - r[{pivot}] / m[{pivot}][{pivot}] * m[{pivot}][j]) END"
    )
    return (
        f"SELECT experiment, dataset, it, beta, CASE WHEN len(m) < {pivot} THEN m "
        f"ELSE list_transform(m, lambda r, i: {row}) END AS m FROM ({matrix})"
    )


def _newton() -> str:
    rows = (
        "SELECT experiment, dataset, it, beta, x, c * (p - label) AS slope, c * p * (1 - p) AS bend FROM "
        "(SELECT w.experiment, w.dataset, w.it, w.beta, t.x, t.c, t.label, "
        "0.5::DOUBLE * (1 + tanh(0.5::DOUBLE * list_dot_product(t.x, w.beta))) AS p "
        f"FROM weights_so_far w JOIN row_train t USING (experiment, dataset) WHERE it < {NEWTON_STEPS})"
    )
    cells = (
        "SELECT experiment, dataset, it, beta, j, k, CASE WHEN k > len(beta) THEN sum(slope * x[j]) + CASE WHEN j > 1 THEN beta[j] ELSE 0 END "
        "ELSE sum(bend * x[j] * x[k]) + CASE WHEN j = k AND j > 1 THEN 1 ELSE 0 END END AS v "
        f"FROM ({rows}) r JOIN places ON j <= len(x) AND k <= len(x) + 1 GROUP BY experiment, dataset, it, beta, j, k"
    )
    lines = f"SELECT experiment, dataset, it, beta, j, list(v ORDER BY k) AS line FROM ({cells}) GROUP BY experiment, dataset, it, beta, j"
    matrix = f"SELECT experiment, dataset, it, beta, list(line ORDER BY j) AS m FROM ({lines}) GROUP BY experiment, dataset, it, beta"
    for pivot in range(1, _width + 1):
        matrix = _eliminated(matrix, pivot)
    return (
        "SELECT experiment, dataset, 0 AS it, list_transform(any_value(x), lambda v: 0.0::DOUBLE) AS beta FROM row_train GROUP BY ALL "
        "UNION ALL SELECT experiment, dataset, it + 1, list_transform(beta, lambda b, j: b - m[j][len(m) + 1]) AS beta "
        f"FROM ({matrix})"
    )


CTES["row_cells"] = " UNION ALL ".join(
    f"SELECT '{name}' AS experiment, dataset, id, label, is_test, [1.0::DOUBLE, {', '.join(f'{c}::DOUBLE' for c in columns)}] AS x "
    "FROM row_split JOIN lexical USING (dataset, id) JOIN grade USING (id) JOIN lexicon USING (dataset, id) JOIN sentiment USING (dataset, id)"
    for name, columns in ROW_EXPERIMENTS
)
CTES["row_split"] = BODIES["stratified_holdout"]
CTES["row_train"] = (
    "SELECT experiment, dataset, x, label, count(*) OVER (PARTITION BY experiment, dataset)::DOUBLE "
    "/ (2 * count(*) OVER (PARTITION BY experiment, dataset, label)) AS c FROM row_cells WHERE is_test = 0"
)
CTES["places"] = f"SELECT j, k FROM range(1, {_width + 1}) AS a(j), range(1, {_width + 2}) AS b(k)"
CTES["weights_so_far"] = _newton()
CTES["row_weights"] = f"SELECT experiment, dataset, beta FROM weights_so_far WHERE it = {NEWTON_STEPS}"
CTES["row_scores"] = (
    "SELECT experiment, dataset, id, label, len(x) - 1 AS n_features, 1 / (1 + exp(-list_dot_product(x, beta))) AS score "
    "FROM row_cells JOIN row_weights USING (experiment, dataset) WHERE is_test = 1"
)
CTES["row_counts"] = "SELECT dataset, experiment, n_features, " + ", ".join(
    f"count(*) FILTER (label = {truth} AND (score > {HALF!r}::DOUBLE)::INT = {guess}) AS {name}"
    for name, truth, guess in (("true_positives", 1, 1), ("true_negatives", 0, 0), ("false_positives", 0, 1), ("false_negatives", 1, 0))
) + " FROM row_scores GROUP BY ALL"
BODIES["logistic_weights"] = (
    "SELECT dataset, experiment, place - 1 AS place, round(beta[place], 4) + 0.0 AS weight FROM "
    "(SELECT *, unnest(range(1, len(beta) + 1))::INT AS place FROM row_weights)"
)
BODIES["logistic_predictions"] = (
    f"SELECT dataset, experiment, id, label, (score > {HALF!r}::DOUBLE)::INT AS prediction, round(score, 4) + 0.0 AS score FROM row_scores"
)
BODIES["row_ablation"] = (
    "SELECT *, round((true_positives + true_negatives)::DOUBLE / (true_positives + true_negatives + false_positives + false_negatives), 6) AS accuracy, "
    f"round({ratio('true_positives', 'true_positives + false_positives')}, 6) AS precision, "
    f"round({ratio('true_positives', 'true_positives + false_negatives')}, 6) AS recall, "
    f"round({ratio('2 * true_positives', '2 * true_positives + false_positives + false_negatives')}, 6) AS f1 FROM row_counts"
)

ORACLES: dict[str, str] = {name: composed(body) for name, body in BODIES.items()}
