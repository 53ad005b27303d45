import pytest

from marquee.session import ensure_checkpoint_dir, require_local


def test_checkpoint_dir_is_read_from_the_session(spark):
    assert ensure_checkpoint_dir(spark) == spark.conf.get("spark.checkpoint.dir")


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "local-cluster[3,2,1024]", "k8s://x"])
def test_cluster_master_needs_a_shared_folder(master):
    with pytest.raises(ValueError):
        require_local(master)


def test_local_master_may_use_scratch():
    require_local("local[8]")
    require_local("local")
