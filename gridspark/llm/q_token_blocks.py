"""Query of the token files."""

import public_tokenizers

from gridspark.llm.base import query, table
from gridspark.llm.token_blocks import encode_blocks, read_documents, shared_path, write_blocks

TOKENIZER = "word_bpe_49k.json"
END_ID = 2


@query("op7_token_blocks")
def op7_token_blocks(spark, sf_dir):
    """Places, sizes and checksums of all documents, from the files written for them."""
    path = shared_path(spark, "token-blocks")
    write_blocks(encode_blocks(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), END_ID, by_chunk=True), path)
    return read_documents(spark, path).drop("ids")
