"""Files made of rows: containers as binary columns, ready to write out."""
