"""Schemas of the engine's tables."""

from tallyforge.functions.intpipe import PIPELINE

PROBLEMS = f"problem_id string, text string, answer bigint, pipeline {PIPELINE}, range_scale string, n_filters int, n_transforms int, total_steps int, tier string, pass8 int, split string"
EXTRA = "struct<sample_idx:int,problem_idx:int,finish_reason:string,answer:bigint,pass8:int,split:string,range_scale:string,total_steps:int,model_id:string,decoding:string,temperature:double,top_p:double,source:string>"
SAMPLES = f"run_id string, config_hash string, arm string, data_condition string, problem_id string, tier string, prompt string, completion string, seed int, extracted_answer bigint, correct boolean, truncated boolean, extraction_failed boolean, reward double, n_tokens int, extra {EXTRA}"
REWARDS = "step int, problem_id string, tier string, reward double, correct boolean, n_tokens int, truncated boolean, extraction_failed boolean, reward_name string, extra map<string,string>"
TIER_STATS = "struct<reward_mean:double,n:int,frac_reward_zero_std:double>"
TRAIN_LOG = f"step int, summary boolean, step_time_s double, wall_clock_s double, reward_mean double, reward_std double, frac_reward_zero_std double, completions_mean_length double, completions_clipped_ratio double, kl double, clip_ratio double, grad_norm double, lr double, loss double, num_tokens double, per_tier map<string,{TIER_STATS}>, n_active_prompts bigint, cumulative_completions bigint, cumulative_training_tokens bigint"
RUN_META = "run_id string, config_hash string, git_sha string, status string, gpu_type string, hostname string, git_dirty boolean, gpu_hours_actual double, wall_clock_s double, started_at string, finished_at string, n_samples int, n_samples_planned int"
BUDGETS = "prompts bigint, completions_available bigint, completions_consumed bigint, training_tokens bigint, optimizer_steps bigint"
SWEEP = "arm string, learning_rate double, epochs int, val_accuracy double, ci_low double, ci_high double, truncation_rate double, status string, selection_split string"
