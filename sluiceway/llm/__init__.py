"""Training-data operators: quality, mixing, chat, decontamination, sharding, joins, counts, extraction, ids, licences."""
