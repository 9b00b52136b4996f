from coffer.streaming.statement_stream import import_stream, read_imported

__all__ = ["import_stream", "read_imported"]
