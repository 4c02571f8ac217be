"""Fixed values shared by the operators."""

# Reserved ids and marker words.
PADDING_ID = 0
UNKNOWN_ID = 1
FIRST_WORD_ID = 2
UNKNOWN_WORD = "<unk>"
START_WORD = "<go>"
STOP_WORD = "<stop>"

# Characters that become a space before splitting, per filter mode.
FILTER_CHARS = {
    "filters": '!"#$%&()*+,-./:;=?@[\\]^_`{|}~\t\n',
    "no_filters": "\t\n",
}

# Default sizes.
DOCUMENT_LENGTH = 2000
SUMMARY_LENGTH = 216
BATCH_SIZE = 32
VOCABULARY_CAP = 100_000
ENCODERS = 4
CURRICULUM_EPOCHS = 10
CURRICULUM_STEPS = 8
BEAM_WIDTH = 6
NGRAM_SIZE = 2
LENGTH_ALPHA = 0.8
