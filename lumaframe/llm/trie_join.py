"""Problem 5: pairs of near-duplicate images. The trie join lies with the operators, which need it too; this is its other name."""

import sys

from lumaframe.operators import tries

sys.modules[__name__] = tries
