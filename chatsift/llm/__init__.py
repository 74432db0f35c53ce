"""Training-data operators: archives, tokens, filters, joins, placement and scans."""
