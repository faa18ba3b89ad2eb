"""Distribution patterns: staging, size checks, hot keys, numbering."""
