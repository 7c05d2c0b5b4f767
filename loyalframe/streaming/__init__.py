from loyalframe.streaming.ingest import (  # noqa: F401
    current_order_lines, order_line_stream, start_order_line_ingest,
)
