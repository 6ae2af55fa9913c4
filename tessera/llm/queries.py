"""The registered queries of this package and their reference SQL."""

import corpus_pipeline
from tessera.llm import (
    byte_bpe,
    chat_masks,
    chat_repair,
    entropy_mix,
    exact_dedup,
    extendible,
    line_crf,
    maxscore,
    pii_bootstrap,
    simhash_mih,
    toxicity_knn,
    warc_index,
    whitening,
)

QUERIES = {
    "op1_exact_dedup": exact_dedup.query,
    "op2_byte_bpe": byte_bpe.query,
    "op3_line_crf": line_crf.query,
    "op4_maxscore": maxscore.query,
    "op5_extendible": extendible.query,
    "op6_entropy_mix": entropy_mix.query,
    "op7_pii_bootstrap": pii_bootstrap.query,
    "op8_toxicity_knn": toxicity_knn.query,
    "op9_warc_index": warc_index.query,
    "op10_simhash_mih": simhash_mih.query,
    "op11_chat_repair": chat_repair.query,
    "op12_chat_masks": chat_masks.query,
    "op13_whitening": whitening.query,
    "pipeline": corpus_pipeline.run,
}

SQL = {
    "op1_exact_dedup": exact_dedup.SQL,
    "op4_maxscore": maxscore.SQL,
    "op5_extendible": extendible.SQL,
    "op9_warc_index": warc_index.SQL,
    "op12_chat_masks": chat_masks.SQL,
} | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
