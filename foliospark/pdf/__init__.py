"""PDF files in plain Python: objects, filters, decryption, fonts, the page interpreter, and a writer for tests and
round trips. Nothing here needs Spark."""
