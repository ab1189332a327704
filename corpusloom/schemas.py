"""Row types of the corpus, as Spark DDL."""

CODE_SAMPLE = "code string, language string, unit_type string, name string, file_path string, start_line int, end_line int, metadata map<string,string>"
CHUNK = "text string, source_file string, chunk_idx int"
REMOTE_CODE = "text string, language string, source string"
REMOTE_CONVERSATION = "text string, source string, category string, message_id string, split string"
CORPUS_ROW = "text string, content string, code string, source string, language string, category string"
MERGED_ROW = "text string, domain string, source string, language string, category string"
GENERATED_PAIR = "verbose string, compressed string, domain string, language string, metadata map<string,string>"
PAIR = "verbose string, compressed string, domain string, metadata map<string,string>"
VALIDATION = "passed boolean, min_equivalence double, compression_ratio double, equivalence_scores map<string,double>, llm_judge_used boolean, llm_judge_scores map<string,double>"
VALIDATED_PAIR = f"{PAIR}, validation struct<passed:boolean,min_equivalence:double,compression_ratio:double,equivalence_scores:map<string,double>,llm_judge_used:boolean,llm_judge_scores:map<string,double>>"
MESSAGES = "messages array<struct<role:string,content:string>>"
JUDGE_REPLY = "verdict string, confidence double, reasoning string, missing_from_compressed array<string>, missing_from_verbose array<string>"
CALL_RECORD = "timestamp timestamp_ntz, model string, input_tokens long, output_tokens long, cost_usd double, operation string"
EVALUATION = "input_text string, domain string, compressed_text string, compression_ratio double, min_equivalence double, equivalence_scores map<string,double>, passed boolean, duration_ms double"
RUN_METADATA = "started_at string, git_sha string, data_dir string, model string, lora_rank int, lora_alpha int, iters int, batch_size int, learning_rate double"
CACHE_ENTRY = "key string, value string, expires_at timestamp"
