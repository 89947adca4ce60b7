"""The operators' queries and their SQL."""

from curatrix.llm import hash_tree, language_id, line_crf, merkle, near_dedup, phrase_automata, poisson_mix, quality_rules, sentencepiece_codec, warc_index


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries():
    return {
        "op1_language_id": language_id.query,
        "op2_merkle_fingerprints": merkle.query,
        "op3_quality_rules": quality_rules.query,
        "op4_prob_min_hash": near_dedup.query,
        "op5_warc_index_merge": warc_index.query,
        "op6_line_crf": line_crf.query,
        "op7_poisson_mix": poisson_mix.query,
        "op8_phrase_automata": phrase_automata.query,
        "op9_hash_tree": hash_tree.query,
        "op10_sentencepiece": sentencepiece_codec.query,
        "pipeline": pipeline,
    }


def oracle_sql():
    return {
        "op3_quality_rules": quality_rules.SQL,
        "op4_prob_min_hash": near_dedup.SQL,
        "op5_warc_index_merge": warc_index.SQL,
        "op7_poisson_mix": poisson_mix.SQL,
        "op8_phrase_automata": phrase_automata.SQL,
        "op9_hash_tree": hash_tree.SQL,
    }
