"""The dealt operators as registered queries: thin wrappers that apply each to its whole table."""

from __future__ import annotations

from . import centroids, chat, html_text, line_dedup, minhash, mixing, packing, phrases, pii, quality, repeats, secrets, simhash
from .common import table


def op1_mixing_sources(spark, sf_dir):
    return mixing.report(table(spark, sf_dir, "documents"))


def op2_html_extraction(spark, sf_dir):
    return html_text.extract(table(spark, sf_dir, "pages"))


def op3_suffix_array_dedup(spark, sf_dir):
    return repeats.report(table(spark, sf_dir, "documents"))


def op4_document_fingerprints(spark, sf_dir):
    return minhash.report(table(spark, sf_dir, "documents"))


def op5_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_simhash(spark, sf_dir):
    return simhash.report(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark, sf_dir):
    return quality.report(table(spark, sf_dir, "documents"))


def op8_secret_scans(spark, sf_dir):
    return secrets.report(table(spark, sf_dir, "documents"))


#: The registered query shows surrogates on test tables: a key that everyone knows. Real texts need a secret one.
SHOWN_KEY = "the key of the registered query"


def op9_pii_surrogates(spark, sf_dir):
    return pii.report(table(spark, sf_dir, "documents"), SHOWN_KEY)


def op10_chat_formatting(spark, sf_dir):
    return chat.digest(chat.probe_rows(table(spark, sf_dir, "conversations")))


def op11_centroid_clustering(spark, sf_dir):
    return centroids.report(table(spark, sf_dir, "embeddings"))


def op12_line_dedup(spark, sf_dir):
    return line_dedup.report(table(spark, sf_dir, "documents"))


def op13_phrase_collocations(spark, sf_dir):
    return phrases.mined(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_mixing_sources, op2_html_extraction, op3_suffix_array_dedup, op4_document_fingerprints, op5_packing, op6_simhash, op8_secret_scans, op7_quality_rules, op9_pii_surrogates, op10_chat_formatting, op11_centroid_clustering, op12_line_dedup, op13_phrase_collocations)}
ORACLES = {"op7_quality_rules": quality.REPORT_SQL, "op10_chat_formatting": chat.DIGEST_SQL, "op11_centroid_clustering": centroids.REPORT_SQL, "op12_line_dedup": line_dedup.REPORT_SQL, "op13_phrase_collocations": phrases.REPORT_SQL}
