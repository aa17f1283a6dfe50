"""Reading PDF files (ISO 32000) into plain Python records, one document at a time."""
