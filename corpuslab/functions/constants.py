"""Fixed values that must equal the reference's for identical results.

They are stated plainly, in their natural order, and used as inline (broadcast-sized) tables.
"""

# --- Fixed values: corpus quality rules -------------------------------------------------
MIN_CONTENT_BYTES = 200
MAX_NON_ALPHA_RATIO = 0.4
MAX_BOILERPLATE_RATIO = 0.5
BOILERPLATE_LINES = [
    "all rights reserved",
    "privacy policy",
    "terms of service",
    "terms and conditions",
    "cookie policy",
    "subscribe to our newsletter",
    "follow us on",
    "share this",
    "click here",
    "read more",
    "skip to content",
    "skip to main content",
]

# --- Fixed values: instance prices (USD per hour), training cost report and fleet cost ----
INSTANCE_HOURLY_PRICES = {
    "p3.2xlarge": 3.06,
    "p3.8xlarge": 12.24,
    "p3.16xlarge": 24.48,
    "p4d.24xlarge": 32.77,
    "p4de.24xlarge": 40.96,
    "p5.48xlarge": 98.32,
    "g5.xlarge": 1.006,
    "g5.2xlarge": 1.212,
    "g5.12xlarge": 5.672,
    "g4dn.xlarge": 0.526,
    "g6.xlarge": 0.805,
    "g6.12xlarge": 6.196,
}

# --- Fixed values: inference bench ----------------------------------------------------------
INFERENCE_COST_PER_HOUR = {
    "p3.8xlarge": 12.24,
    "p3.2xlarge": 3.06,
    "g5.xlarge": 1.006,
    "g5.2xlarge": 1.212,
}
API_PRICES_PER_1M = {
    "Claude Sonnet 4.6 output": 15.00,
    "Claude Haiku 4.5 output": 5.00,
    "GPT-4o output": 15.00,
}
PROMPTS = [
    "Explain the difference between FSDP and DDP in distributed training.",
    "What is the purpose of gradient accumulation in large batch training?",
    "Describe how NVLink improves multi-GPU training performance.",
    "What are the tradeoffs between model parallelism and data parallelism?",
    "How does mixed precision training reduce memory usage?",
    "Explain the concept of Model FLOPs Utilization (MFU).",
    "What happens during an all-reduce operation in distributed training?",
    "Why is checkpoint management critical for large-scale training runs?",
    "Describe the memory savings from ZeRO Stage 3 optimization.",
    "What is pipeline parallelism and when should you use it?",
]

# --- Fixed values: peak FP16 TFLOPS per GPU model, MFU ----------------------------------------
GPU_TFLOPS = {"V100": 125.0, "A100": 312.0, "H100": 989.8}
DEFAULT_GPU_MODEL = "V100"

# --- Fixed values: quality gate and alarm ------------------------------------------------------
GATE_MAX_SAMPLES = 500
GATE_BASELINE_TOLERANCE = 1.05
ALARM_PERIOD_SEC = 300
ALARM_EVALUATION_PERIODS = 3
ALARM_THRESHOLD = 5.0
