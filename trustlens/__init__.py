"""trustlens: review trust, sentiment and aspect analytics on Spark DataFrames."""

from trustlens.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
