"""Classification of failures by the kind of error named before the first colon."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Error text -> category, impact, retryable.
ERRORS = {
    "API error": ("kline_data_acquisition_failed", "high", True),
    "HTTP error": ("market_data_connection_failed", "high", True),
    "IO error": ("kline_file_operation_failed", "medium", True),
    "JSON parsing error": ("kline_data_parsing_failed", "medium", False),
    "CSV error": ("kline_export_failed", "medium", False),
    "Time parsing error": ("kline_timestamp_invalid", "low", False),
    "Configuration error": ("kline_service_configuration_invalid", "low", False),
    "Data error": ("kline_data_validation_failed", "medium", False),
    "Database error": ("kline_data_persistence_failed", "high", False),
    "WebSocket error": ("realtime_market_data_failed", "medium", True),
    "URL parsing error": ("market_endpoint_invalid", "low", False),
    "WebSocket protocol error": ("market_data_stream_failed", "medium", False),
    "HTTP request error": ("market_data_request_malformed", "medium", False),
    "Address parse error": ("market_server_address_invalid", "low", False),
    "SQLite error": ("kline_storage_operation_failed", "high", True),
    "Web server error": ("kline_api_server_failed", "medium", False),
    "Aggregation error": ("kline_aggregation_logic_failed", "medium", False),
    "Parse error": ("market_data_format_invalid", "medium", False),
    "Channel error": ("kline_processing_pipeline_failed", "medium", True),
    "Actor error": ("kline_processing_actor_failed", "medium", False),
    "Channel closed": ("kline_processing_channel_closed", "medium", False),
    "Operation timeout": ("kline_operation_timeout", "medium", True),
    "Invalid input": ("kline_input_validation_failed", "low", False),
    "Initialization error": ("kline_service_initialization_failed", "high", False),
    "Unknown error": ("kline_service_unknown_error", "medium", False),
}
# A database error is worth a retry when its text has one of these words.
TRANSIENT_WORDS = ("locked", "busy", "timeout")


def error_kind(message: Column) -> Column:
    """Trimmed text before the first colon."""
    return F.trim(F.substring_index(message, ":", 1))


def classify_error(message: Column) -> Column:
    """Struct ``category, impact, retryable``; a kind outside the table counts as unknown."""
    table = F.create_map(
        *(
            x
            for k, (category, impact, retry) in ERRORS.items()
            for x in (
                F.lit(k),
                F.struct(F.lit(category).alias("category"), F.lit(impact).alias("impact"), F.lit(retry).alias("retryable")),
            )
        )
    )
    kind = error_kind(message)
    found = F.coalesce(F.try_element_at(table, kind), F.try_element_at(table, F.lit("Unknown error")))
    transient = F.lit(False)
    for w in TRANSIENT_WORDS:
        transient = transient | message.contains(w)
    return F.struct(
        found["category"].alias("category"),
        found["impact"].alias("impact"),
        (found["retryable"] | ((kind == "Database error") & transient)).alias("retryable"),
    )
