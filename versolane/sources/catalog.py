"""The price catalogue and provider availability: small dimensions of fixed size, safe to broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Model, provider, display name, USD per million input and output tokens, quality, speed, cost indicator, badge, description.
MODELS = [
    ("gpt-5.2", "openai", "GPT-5.2", 5.00, 20.00, "very_high", "fast", "$$$", "Ultimo Modello", "Il modello piu avanzato di OpenAI"),
    ("gpt-4.1", "openai", "GPT-4.1", 2.00, 8.00, "high", "fast", "$$", "Bilanciato", "Ottimo rapporto qualita/prezzo"),
    ("gpt-4.1-mini", "openai", "GPT-4.1 Mini", 0.40, 1.60, "good", "very_fast", "$", "Budget", "Veloce e economico"),
    ("gpt-4.1-nano", "openai", "GPT-4.1 Nano", 0.10, 0.40, "basic", "very_fast", "$", "Ultra Budget", "Il piu economico di OpenAI"),
    ("gpt-4o", "openai", "GPT-4o", 2.50, 10.00, "high", "fast", "$$", "Popolare", "Modello multimodale affidabile"),
    ("gpt-4o-mini", "openai", "GPT-4o Mini", 0.15, 0.60, "good", "very_fast", "$", "Budget", "Veloce e molto economico"),
    ("o4-mini", "openai", "o4-mini", 1.10, 4.40, "high", "fast", "$$", "Ragionamento", "Reasoning veloce"),
    ("o3", "openai", "o3", 10.00, 40.00, "very_high", "slow", "$$$$", "Deep Reasoning", "Ragionamento avanzato"),
    ("o3-mini", "openai", "o3-mini", 1.10, 4.40, "good", "fast", "$$", "Veloce", "Reasoning compatto"),
    ("o1", "openai", "o1", 15.00, 60.00, "very_high", "slow", "$$$$", "Ragionamento", "Reasoning originale di OpenAI"),
    ("claude-opus-4-20250514", "anthropic", "Claude Opus 4", 15.00, 75.00, "very_high", "slow", "$$$$", "Miglior Qualita", "Il modello piu potente di Anthropic"),
    ("claude-sonnet-4-20250514", "anthropic", "Claude Sonnet 4", 3.00, 15.00, "high", "fast", "$$", "Bilanciato", "Ottimo bilanciamento qualita/velocita"),
    ("claude-haiku-3-5-20241022", "anthropic", "Claude Haiku 3.5", 0.80, 4.00, "good", "very_fast", "$", "Veloce", "Velocissimo e economico"),
]
#: Models whose output cap goes by the newer name.
COMPLETION_CAP = ("gpt-5.2", "o1", "o3", "o3-mini", "o4-mini")
#: The default model, and the default for detection, of each provider, in order of preference.
DEFAULTS = {"anthropic": "claude-sonnet-4-20250514", "openai": "gpt-4o"}
DETECTION = {"anthropic": "claude-haiku-3-5-20241022", "openai": "gpt-4o-mini"}


def models(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MODELS, "model string, provider string, display_name string, input_cost double, output_cost double, quality string, speed string, cost_indicator string, quality_badge string, description string")


def providers(spark: SparkSession, openai: bool = True, anthropic: bool = False) -> DataFrame:
    """Which providers can be used: configuration, not secrets."""
    return spark.createDataFrame([("openai", openai), ("anthropic", anthropic)], "provider string, available boolean")


def default_model(openai: bool, anthropic: bool) -> str | None:
    return DEFAULTS["anthropic"] if anthropic else DEFAULTS["openai"] if openai else None
