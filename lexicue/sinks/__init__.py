"""Writers: table appends and overwrites, nested documents, timed captions."""
