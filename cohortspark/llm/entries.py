"""Modules that register queries."""

MODULES = ["cohortspark.llm.q_mixing", "cohortspark.llm.q_chat", "cohortspark.llm.q_jaccard", "cohortspark.llm.q_packing", "cohortspark.llm.q_pii", "cohortspark.llm.q_langid", "cohortspark.llm.q_quality", "cohortspark.llm.q_html", "cohortspark.llm.q_fingerprint", "cohortspark.llm.q_neighbours", "cohortspark.llm.q_bpe", "cohortspark.llm.q_align", "cohortspark.llm.q_repair"]
