"""Record layouts, as DDL strings that readers are given explicitly."""

CONTEXT = "array<struct<title: string, sentences: array<string>>>"
SUPPORT = "array<struct<title: string, sent_id: int>>"

#: On disk both nested lists are mixed arrays; see ``sources.readers.multihop``.
MULTIHOP_RAW = "_id string, question string, answer string, supporting_facts array<array<string>>, context array<array<string>>, type string, level string"
MULTIHOP = f"_id string, question string, answer string, supporting_facts {SUPPORT}, context {CONTEXT}, type string, level string"
CANDIDATE_RAW = MULTIHOP_RAW + ", candidates array<string>, judgements array<int>, betas array<double>, source string"
PARAGRAPHS = "array<struct<idx: int, title: string, paragraph_text: string, is_supporting: boolean>>"
PARAGRAPH_QA = f"id string, question string, answer string, paragraphs {PARAGRAPHS}, question_decomposition array<struct<paragraph_support_idx: int>>"
OPEN_QA = "id string, question string, golden_answers array<string>"
LONG_CONTEXT = "_id string, input string, context string, answers array<string>"
RULER = "index bigint, input string, outputs array<string>, length_w_model_temp bigint, answer_prefix string"

GSM = "question string, answer string"
MATH = "id bigint, problem string, solution string, answer string"
ENDINGS = "ind bigint, ctx string, endings array<string>, label int"
OPTIONS = "question_id bigint, question string, options array<string>, answer string"
SUMMARY = "id string, text string, summary string"

SAMPLE = "id string, question string, answer string, chunks array<string>, sf_idx array<int>, source string"
RETRIEVER_LOG = "id string, question string, answer string, sf_idx array<int>, pred_idx array<int>, q_values array<double>, sf_texts array<string>, pred_texts array<string>, return double, text_len bigint, f1 double, em double"
READER_RESULT = "question string, retrieved_chunks_idx array<int>, ground_truth_chunks_idx array<int>, filter_idx array<int>, filter_texts array<string>, ground_truth string, prediction string, full_model_output string, EM int, F1 double, LLM_Judge_Score double"
MODE = "struct<context: string, generations: array<string>, judgements: array<int>, success_rate: double>"
SUCCESS_RATE = f"dataset string, split string, id string, question string, answer string, level string, type string, chunks array<string>, sf_idx array<int>, noise_idx array<int>, chunk_count int, sf_count int, question_only {MODE}, with_support_facts {MODE}, question_only_success_rate double, with_support_facts_success_rate double"
CANDIDATES = "id string, question string, answer string, candidates array<string>, judgements array<int>, betas array<double>"
STEP_LOG = "episode string, step int, reward double, v_next double, not_done int, q double"
