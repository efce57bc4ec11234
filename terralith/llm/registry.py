"""The queries and SQL of this subpackage."""

from __future__ import annotations

from terralith.llm import decontaminate, flac, html, licenses, mixture, negatives, ngram_join, pieces, quality, runs, sstable, urls, warc


def _pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {
        "op1_html_extract": html.op1_html_extract,
        "op2_ngram_jaccard_join": ngram_join.op2_ngram_jaccard_join,
        "op3_token_sstable": sstable.op3_token_sstable,
        "op4_url_filter": urls.op4_url_filter,
        "op5_license_scan": licenses.op5_license_scan,
        "op6_sentencepiece": pieces.op6_sentencepiece,
        "op7_quality_gam": quality.op7_quality_gam,
        "op8_warc": warc.op8_warc,
        "op9_decontamination": decontaminate.op9_decontamination,
        "op10_flac": flac.op10_flac,
        "op11_hard_negatives": negatives.op11_hard_negatives,
        "op12_source_mix": mixture.op12_source_mix,
        "op13_periodic_runs": runs.op13_periodic_runs,
        "pipeline": _pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {"op8_warc": warc.OP8_SQL, "op9_decontamination": decontaminate.OP9_SQL, "op11_hard_negatives": negatives.OP11_SQL, "op12_source_mix": mixture.OP12_SQL}
