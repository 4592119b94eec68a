"""Plan-level building blocks: checked broadcasts, skew-safe scans and top-n, the reader list."""
