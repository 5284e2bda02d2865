"""Sequential networks: layers on float32 arrays (channels last), training by gradient sums over a DataFrame or on arrays."""

from quillmill.nn.activations import *  # noqa: F403
from quillmill.nn.convolution import *  # noqa: F403
from quillmill.nn.core import *  # noqa: F403
from quillmill.nn.losses import *  # noqa: F403
from quillmill.nn.normalization import *  # noqa: F403
from quillmill.nn.optimizers import *  # noqa: F403
from quillmill.nn.pooling import *  # noqa: F403
from quillmill.nn.recurrent import *  # noqa: F403
from quillmill.nn.sequential import *  # noqa: F403
