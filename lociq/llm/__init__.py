"""Training-data operators: token counts, deduplication, language-model scores,
byte-pair encoding, sharding, packing, chat parsing, quality rules and licences."""
