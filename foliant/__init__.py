"""foliant: analytics over collections of PDF files and other binary payloads, on Spark."""
