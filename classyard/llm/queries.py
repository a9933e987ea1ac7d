"""Registered queries of the dealt operators, with production parameters."""
from __future__ import annotations

from classyard.llm.common import read


def op1_rans_tokens(spark, sf_dir):
    import public_tokenizers
    from classyard.llm.rans import token_digests
    return token_digests(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_prob_minhash(spark, sf_dir):
    from classyard.llm.prob_minhash import near_classes
    return near_classes(read(spark, sf_dir, "documents"))


def op6_pack_bfd(spark, sf_dir):
    import public_tokenizers
    from classyard.llm.pack_bfd import packed_digests
    return packed_digests(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_fuse_dedup(spark, sf_dir):
    from classyard.llm.fuse_dedup import dedup_digests
    return dedup_digests(read(spark, sf_dir, "documents"))


def op4_flow_mix(spark, sf_dir):
    from classyard.llm.mix_flow import mix_digests
    return mix_digests(read(spark, sf_dir, "documents"))


def op2_url_logreg(spark, sf_dir):
    from classyard.llm.url_filter import judge
    return judge(read(spark, sf_dir, "pages"))


def op7_tool_links(spark, sf_dir):
    from classyard.llm.tool_chat import chat_rows
    return chat_rows(read(spark, sf_dir, "conversations"))


def op8_suffix_runs(spark, sf_dir):
    from classyard.llm.suffix_dedup import dedup_digests
    return dedup_digests(read(spark, sf_dir, "documents"))


def op9_ordinal_toxicity(spark, sf_dir):
    from classyard.llm.toxicity import judge
    return judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op10_weak_quality(spark, sf_dir):
    from classyard.llm.weak_quality import judge
    return judge(read(spark, sf_dir, "documents"))


def op11_trie_join(spark, sf_dir):
    from classyard.llm.trie_join import linked
    return linked(read(spark, sf_dir, "documents"))


def op12_prefix_rollup(spark, sf_dir):
    from classyard.llm.prefix_rollup import node_digests
    return node_digests(read(spark, sf_dir, "conversations"))


def op13_part_enum(spark, sf_dir):
    from classyard.llm.spelling_enum import corpus_variants
    return corpus_variants(read(spark, sf_dir, "documents"))


def queries() -> dict:
    fns = [op1_rans_tokens, op2_url_logreg, op3_fuse_dedup, op4_flow_mix, op5_prob_minhash, op6_pack_bfd, op7_tool_links, op8_suffix_runs, op9_ordinal_toxicity, op10_weak_quality,
           op11_trie_join, op12_prefix_rollup, op13_part_enum]
    return {f.__name__: f for f in fns}


def oracle_sql() -> dict[str, str]:
    from classyard.llm import fuse_dedup, mix_flow, prefix_rollup, spelling_enum, tool_chat, trie_join
    return {"op3_fuse_dedup": fuse_dedup.ORACLE_SQL, "op4_flow_mix": mix_flow.ORACLE_SQL, "op7_tool_links": tool_chat.ORACLE_SQL,
            "op12_prefix_rollup": prefix_rollup.ORACLE_SQL,
            "op11_trie_join": trie_join.ORACLE_SQL, "op13_part_enum": spelling_enum.ORACLE_SQL}
