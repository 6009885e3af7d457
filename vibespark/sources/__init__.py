"""Reading recordings, catalogs and logs; writing result tables."""
