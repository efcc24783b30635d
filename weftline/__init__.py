"""weftline: iterative question-answer data sets as DataFrame, SQL and Structured Streaming programs."""
